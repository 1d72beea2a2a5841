"""Language ID by cross-parsing: the language whose labelled text needs fewest phrases.

For each language a suffix automaton of a bounded sample of labelled text is built.  A text
is parsed against it greedily: a phrase is the longest match from where the last one ended.
Phrases times log2 of the sample's length, over the text's length, estimate the cross-entropy;
the language with the least wins, the first by name among equals.

The automata become dense transition tables, a failing step carrying the restart and a flag,
so many places of many texts are parsed at the same time, one numpy gather a step.  For that
a text is parsed in blocks of ``BLOCK`` bytes, all from the root at first.  Each later block is
then followed from the state in which the block before it really ended, until both parses
meet, as greedy parses soon do; so the phrases are those of one parse of the whole text,
whatever its length.  Letters are lower-cased, and a run of other ASCII characters is one space.

The model learns every language that has a label.  It is fitted on a bounded sample: for each
language at most ``SAMPLE_DOCS`` documents, the first by a hash, and of each a slice of at most
``DOC_CHARS`` characters from a place that the hash gives; together at most ``LANG_BYTES`` bytes
a language and ``ALL_BYTES`` in all, dealt evenly over languages and documents.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every
text if there is nothing to learn from; a null doc_id is in fold 0; repeated rows get equal
results; an empty table gives an empty result, and further columns are not read.  Of documents with
the same id each is learnt from.  The score is the winner's margin: 1 - its entropy / the
second's; 1 if there is one language only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.labelled import fold
from folioscope.llm.scratch import cut, small
from folioscope.llm.wordhash import PUNCTUATION, text_buffers

FOLDS, HELD_OUT = 4, 2
SAMPLE_DOCS, DOC_CHARS = 64, 4_000
LANG_BYTES, ALL_BYTES = 40_000, 400_000
BLOCK = 1024
#: Bytes parsed at a time, about.
PIECE = 1 << 21

_FLAG = 1 << 30
_DIGITS = np.zeros(256, bool)
_DIGITS[0x30:0x3A] = True
_GAP = PUNCTUATION | _DIGITS


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts with runs of other ASCII characters as one space, and the offsets of the texts."""
    data, at = text_buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    b = data[at[0] : at[-1]].copy()
    at = at - at[0]
    gap = _GAP[b]
    b[gap] = 0x20
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    inner = at[at < len(b)]
    keep[inner] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return b[keep], kept[at]


def suffix_automaton(s: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``s``; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@lru_cache(2)
def _tables(model: tuple[tuple[str, bytes], ...]) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """Class of each byte, number of classes, and for each language the next state (times classes) by state and class."""
    seen = sorted(set(b"".join(s for _, s in model)))
    kind = np.zeros(256, np.int32)
    kind[seen] = np.arange(1, len(seen) + 1)
    width, out = len(seen) + 1, []
    for _, sample in model:
        nxt = suffix_automaton(sample)
        # A byte that the sample hasn't is a phrase of its own: it leads to a last state that no byte continues.
        first = np.full(width, len(nxt) * width, np.int32)
        for c, to in nxt[0].items():
            first[kind[c]] = to * width
        table = np.tile(first | _FLAG, (len(nxt) + 1, 1))
        table[0] = first
        for state, to in enumerate(nxt):
            if to:
                table[state, kind[list(to)]] = np.array(list(to.values()), np.int32) * width
        out.append(table.ravel())
    return kind, width, out


def _resume(table: np.ndarray, c: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parses blocks from ``state`` beside parses from the root until the two meet.

    Phrases more than from the root, whether they met, and the states at the ends of those that did not.
    """
    true, root, more = state.copy(), np.zeros_like(state), np.zeros(len(state), np.int64)
    apart, step = np.nonzero(true != root)[0], 0
    while len(apart) and len(apart := apart[size[apart] > step]):
        now = c[start[apart] + step]
        a, b = table[true[apart] + now], table[root[apart] + now]
        more[apart] += (a >> 30) - (b >> 30)
        true[apart], root[apart] = a & (_FLAG - 1), b & (_FLAG - 1)
        apart = apart[true[apart] != root[apart]]
        step += 1
    return more, true == root, true


def entropies(texts: pa.Array, model: tuple[tuple[str, bytes], ...]) -> np.ndarray:
    """Estimated cross-entropy of each text (rows) for each language (columns)."""
    kind, _, tables = _tables(model)
    b, at = normalise(texts)
    c = kind[b]
    sizes = np.diff(at)
    blocks = -(-sizes // BLOCK)
    of = np.repeat(np.arange(len(sizes)), blocks)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = at[of] + rank * BLOCK
    size = np.minimum(at[of + 1] - start, BLOCK)
    order = np.argsort(-size, kind="stable")
    first, live = start[order], np.searchsorted(-size[order], -np.arange(1, BLOCK + 1), side="right")
    phrases = np.zeros((len(tables), len(start)), np.int64)
    state = np.zeros((len(tables), len(start)), np.int32)
    for step in range(int(size.max()) if len(size) else 0):
        n = live[step]
        now = c[first[:n] + step]
        for k, table in enumerate(tables):
            to = table[state[k, :n] + now]
            phrases[k, :n] += to >> 30
            state[k, :n] = to & (_FLAG - 1)
    total = np.empty((len(sizes), len(tables)))
    for k, table in enumerate(tables):
        count, ends = np.empty(len(of), np.int64), np.empty(len(of), np.int32)
        count[order], ends[order] = phrases[k], state[k]
        alone, more = ends.copy(), np.zeros(len(of), np.int64)
        todo = np.nonzero(rank > 0)[0]
        while len(todo):
            more[todo], met, true = _resume(table, c, start[todo], size[todo], ends[todo - 1])
            now = np.where(met, alone[todo], true)
            moved = todo[now != ends[todo]]
            ends[todo] = now
            todo = moved[moved + 1 < len(of)] + 1
            todo = todo[rank[todo] > 0]
        total[:, k] = np.bincount(of, count + more, len(sizes)) + (sizes > 0)
    return np.maximum(total, 1) * np.log2([max(len(s), 2) for _, s in model]) / np.maximum(sizes, 1)[:, None]


def dealt(sizes: list[int], room: int) -> list[int]:
    """How much each of some texts gives, so that all give as evenly as they can and ``room`` in all at most."""
    out, left = [0] * len(sizes), room
    by_size = sorted(range(len(sizes)), key=sizes.__getitem__)
    for k, i in enumerate(by_size):
        out[i] = min(sizes[i], left // (len(sizes) - k))
        left -= out[i]
    return out


def learn(docs: DataFrame) -> tuple[tuple[str, bytes], ...]:
    """(language, sample) for each language of ``docs`` (doc_id, text, lang)."""
    usable = docs.where((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    marked = usable.select("lang", "doc_id", "text", F.xxhash64("doc_id", "text").alias("mark"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "doc_id"))
    # Each partition ranks its own rows first, so no language's rows meet in one task.
    chosen = cut(marked.select("lang", "doc_id", "mark").withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS), "chosen")
    # Letters stand somewhere in the text; a slice begins before its end by as much as it is long.
    at = F.pmod("mark", F.greatest(F.length("text") - DOC_CHARS + 1, F.lit(1)).cast("long")).cast("int") + 1
    rows = marked.select("lang", "mark", F.substr("text", at, F.lit(DOC_CHARS)).alias("text"))
    found = rows.join(small(chosen.select("lang", "mark").distinct(), 64), ["lang", "mark"]).dropDuplicates(["lang", "mark"]).orderBy("lang", "mark").collect()
    by_lang: dict[str, list[str]] = {}
    for row in found:
        by_lang.setdefault(row["lang"], []).append(row["text"])
    room = min(LANG_BYTES, ALL_BYTES // max(1, len(by_lang)))
    model = []
    for lang, texts in sorted(by_lang.items()):
        b, at = normalise(pa.array([t + " " for t in texts]))
        parts = [b[lo : lo + n] for lo, n in zip(at, dealt(np.diff(at).tolist(), room))]
        model.append((lang, np.concatenate(parts).tobytes()))
    return tuple(model)


def predict(docs: DataFrame, model: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs`` (doc_id, text)."""
    if not model:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = np.array([*(lang for lang, _ in model), "und"], object)

    def of_texts(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        h = entropies(texts.fill_null(""), sent.value)
        best = h.argmin(axis=1)
        ranked = np.sort(h, axis=1)
        score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12) if h.shape[1] > 1 else np.ones(len(h))
        letters = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
        best, score = np.where(letters, best, len(names) - 1), np.where(letters, np.clip(score, 0, 1), 0.0)
        return pa.RecordBatch.from_arrays([ids, pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    def run(batches):
        for batch in batches:
            _, at = text_buffers(batch.column(1))
            first = 0
            while first < batch.num_rows:
                end = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, side="right")) - 1)
                yield of_texts(batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first))
                first = end

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, learn(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
