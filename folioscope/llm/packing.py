"""Packing of documents into training sequences by a configuration linear program.

Documents are cut into pieces of at most a sequence's length; only longer ones are cut, and
only their first piece may be shorter.  Which lengths share a sequence is decided on the
histogram of piece lengths, which has at most as many entries as a sequence has tokens.

The configuration program (fewest sequences whose contents cover the histogram) is solved by
multiplicative weights on both sides.  A knapsack over the capacity, by dynamic programming,
prices all lengths at once: it gives the best configuration with each length, and a lower
bound of the program.  Between two pricings the weights of the configurations met so far are
multiplied, again and again, by what their contents lack, until all lengths are covered alike;
the prices of the lengths move with them.  The fractional weights are rounded down to whole
sequences, then up while the pieces last, and the few pieces left go by best fit.

The plan counts alike sequences rather than listing them, so its size depends on the number of
lengths and configurations kept and not on the number of pieces; it is broadcast, and has at
most a few entries for each of POOL configurations and what they leave over.  A piece finds its
place from its rank among the pieces of its length.  The task that cuts a piece counts those of
its length before it; adding the counts of the tasks before gives the rank, so no piece is
sorted or moved, whatever share of all pieces a length has.

Defined cases: null text is empty; an empty text is its end token; repeated rows are packed
each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.scratch import cut, small

SEQUENCE = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"

#: Pricings at most; multiplicative updates after each; their relaxation; heat at the start and the end.
ROUNDS, UPDATES, RELAX, HOT, COLD = 120, 60, 1.8, 0.02, 1e-5
#: A rounding comes every so many pricings; plans within this share of the bound end the search.
ROUNDED, TIGHT = 8, 0.0005
#: Configurations that are kept from one pricing to the next, at most; parts of a sequence that are rounded up, at least.
POOL, UP = 16_000, 0.3

#: Words that a worker remembers, and characters that it splits at a time.
MEMORY, SPLIT = 240_000, 1 << 18

#: Fixed value: the pattern by which the byte-level tokenizer cuts text into words.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts without the characters of _ODD, on which the faster engine's classes differ.
_PLAIN = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD = regex.compile(r"[\p{No}\p{Nl}\x1c-\x1f]")
_ODD_ASCII = re.compile(r"[\x1c-\x1f]")
_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Token ids, as little-endian 32-bit bytes, of each word met so far.

    A word of a byte-level tokenizer without a normalizer goes to its merging model directly.
    ``split`` parts a text at the tokenizer's added tokens, which are matched before words are;
    ``added`` has their ids.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()
        if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or tokenizer.pre_tokenizer.add_prefix_space:
            raise ValueError("a byte-level tokenizer without a normalizer or a prefix space is needed")
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()) or len({t.normalized for t in added.values()}) > 1:
            raise ValueError("added tokens that are matched as they are, all at once, are needed")
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(longest)})" if longest else r"(?!)").split

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:  # the words met first are the frequent ones
            kept = list(islice(self.items(), MEMORY // 2))
            self.clear()
            self.update(kept)
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        out = array("I", [t.id for t in tokens]).tobytes()
        self[word] = out
        return out


@lru_cache(1)
def _words(path: str) -> _Words:
    from tokenizers import Tokenizer

    return _Words(Tokenizer.from_file(path))


def split_words(text: str) -> list[str]:
    odd = _ODD_ASCII if text.isascii() else _ODD
    return (PRETOKEN if odd.search(text) else _PLAIN).findall(text)


def token_bytes(text: str, words: _Words) -> bytes:
    """Ids of ``text`` and the end token, 4 bytes each.

    Added tokens are taken first; what lies between two is split on its own.  No merge crosses
    a word, so words are encoded once each; a long text is split between two words, where the
    pattern always ends one.
    """
    parts = []
    for run in words.split(text) if any(t in text for t in words.added) else (text,):
        if run in words.added:
            parts.append(words.added[run])
            continue
        at = 0
        while len(run) - at > SPLIT and (gap := _SAFE.search(run, at + SPLIT)):
            parts.append(b"".join(map(words.__getitem__, split_words(run[at : gap.start()]))))
            at = gap.start()
        parts += map(words.__getitem__, split_words(run[at:] if at else run))
    parts.append(END_ID.to_bytes(4, "little"))
    return b"".join(parts)


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ids if wanted, of each piece of each row of ``docs`` (doc_id, text).

    chunk and nth name the task that cut a piece and how many of its length that task had cut before.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        words, chunk, seen = _words(tokenizer), TaskContext.get().partitionId(), [0] * (sequence + 1)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows, piece, start, length, crc, nth, ids = array("q"), array("i"), array("q"), array("q"), array("q"), array("q"), []
                for k, text in enumerate(batch.column(1).slice(i, 256).to_pylist()):
                    data = token_bytes(text or "", words)
                    n = len(data) // 4
                    at, number = 0, 0
                    size = n % sequence or sequence
                    while at < n:
                        size = min(size, n - at) if not number else sequence
                        part = data[4 * at : 4 * (at + size)]
                        rows.append(k), piece.append(number), start.append(at), length.append(size), crc.append(zlib.crc32(part)), nth.append(seen[size])
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                        at, number = at + size, number + 1
                        seen[size] += 1
                cols = [batch.column(0).slice(i, 256).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                cols += [pa.array([chunk] * len(rows), pa.int32()), pa.array(nth, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, chunk int, nth long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def priced(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack table of the lengths' values: the most value within each capacity, and the length that was put in last (0: none)."""
    best, last, top = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), len(value) - 1
    for c in range(1, capacity + 1):
        k = min(c, top)
        gain = value[1 : k + 1] + best[c - k : c][::-1]
        i = int(gain.argmax())
        best[c], last[c] = (gain[i], i + 1) if gain[i] > best[c - 1] else (best[c - 1], 0)
    return best, last


def with_each(last: np.ndarray, lengths: np.ndarray, capacity: int, top: int) -> np.ndarray:
    """For each of some lengths, the counts by length of the best configuration that holds it."""
    a, row, room = np.zeros((len(lengths), top + 1), np.int32), np.arange(len(lengths)), capacity - lengths
    a[row, lengths] += 1
    while (room > 0).any():
        put = last[room]
        some = put > 0
        a[row[some], put[some]] += 1
        room = room - np.where(some, put, np.minimum(room, 1))
    return a


#: Pieces by length of a sequence: (length, count) pairs.
Contents = tuple[tuple[int, int], ...]


class Configurations:
    """A pool of configurations with fractional weights, as sparse columns over the lengths of a histogram."""

    def __init__(self, count: np.ndarray, capacity: int):
        self.capacity, self.top = capacity, len(count) - 1
        self.lengths = np.nonzero(count)[0]
        self.n, self.share = count[self.lengths].astype(float), self.lengths / capacity
        self.place = np.zeros(len(count), np.int64)
        self.place[self.lengths] = np.arange(len(self.lengths))
        self.price, self.bound = self.share.copy(), float(self.n @ self.share)
        self.mark, self.marks = np.random.default_rng(0).integers(1, 1 << 62, len(count)), np.zeros(0, np.int64)
        self.row, self.col, self.times, self.x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def extend(self) -> None:
        """Prices all lengths by one knapsack table; adds the best configuration with each, and improves the bound."""
        value = np.zeros(self.top + 1)
        value[self.lengths] = self.price
        best, last = priced(value, self.capacity)
        self.bound = max(self.bound, float(self.n @ self.price) / best[self.capacity])
        each = with_each(last, self.lengths, self.capacity, self.top)
        marks, new = np.unique(each @ self.mark, return_index=True)
        fresh = ~np.isin(marks, self.marks)
        each = each[new[fresh]]
        c, length = np.nonzero(each)
        self.row = np.concatenate([self.row, self.place[length]])
        self.times = np.concatenate([self.times, each[c, length].astype(float)])
        self.col = np.concatenate([self.col, c + len(self.x)])
        self.x, self.marks = np.concatenate([self.x, np.zeros(len(each))]), np.concatenate([self.marks, marks[fresh]])

    def reweigh(self, heat: float) -> float:
        """One round of multiplicative updates; the largest departure of a coverage from 1, as a logarithm.

        A configuration weighs exp((its price - 1) / heat).  The price of a length moves by the
        logarithm of its coverage, times its share of a sequence; so each weight is multiplied by
        a mean, of weights that sum to 1 at most, of what its contents lack, and no step overshoots.
        """
        first = np.searchsorted(self.col, np.arange(len(self.x)))
        for _ in range(UPDATES):
            value = np.add.reduceat(self.price[self.row] * self.times, first)
            self.x = self.bound / len(self.x) * np.exp(np.minimum((value - 1) / heat, 30))
            cover = np.bincount(self.row, self.x[self.col] * self.times, len(self.n)) / self.n
            step = np.log(np.maximum(cover, 1e-9))
            self.price = np.maximum(self.price - RELAX * heat * self.share * step, 0)
        return float(np.abs(np.where(self.price > 0, step, np.maximum(-step, 0))).max())

    def prune(self) -> None:
        """Beyond POOL configurations, half as many of most weight stay; others come back if they are worth it."""
        if len(self.x) <= POOL:
            return
        keep = np.zeros(len(self.x), bool)
        keep[np.argsort(-self.x)[: POOL // 2]] = True
        number, own = np.cumsum(keep) - 1, keep[self.col]
        self.row, self.times, self.col = self.row[own], self.times[own], number[self.col[own]]
        self.x, self.marks = self.x[keep], self.marks[keep]

    def rounded(self, left: np.ndarray) -> list[tuple[Contents, int]]:
        """Whole sequences that hold ``left``: weights rounded down, then up while their pieces last, and best fit for the rest."""
        left, out = left.copy(), {}
        first = np.searchsorted(self.col, np.arange(len(self.x) + 1))
        part = self.x + 1e-3 - np.floor(self.x + 1e-3)
        down = [(c, int(self.x[c] + 1e-3)) for c in np.argsort(-self.x) if self.x[c] + 1e-3 >= 1]
        up = [(c, 1) for c in np.argsort(-part) if part[c] >= UP]
        for c, most in down + up:
            own, k = self.lengths[self.row[first[c] : first[c + 1]]], self.times[first[c] : first[c + 1]].astype(np.int64)
            times = min(most, int((left[own] // k).min()))
            if times:
                left[own] -= times * k
                held = tuple(zip(own.tolist(), k.tolist()))
                out[held] = out.get(held, 0) + times
        return list(out.items()) + best_fit(left, self.capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[Contents, int]]:
    """Configurations for the remaining pieces, longest first, each into the fullest sequence that has room.

    Sequences of equal contents are one entry with a count, and all pieces of a length go at
    once, so the work depends on the number of lengths, not of pieces.
    """
    by_room: dict[int, dict[Contents, int]] = {}

    def add(room: int, held: Contents, n: int) -> None:
        if n:
            slot = by_room.setdefault(room, {})
            slot[held] = slot.get(held, 0) + n

    for length in np.nonzero(left)[0][::-1].tolist():
        n = int(left[length])
        for room in sorted(r for r in by_room if r >= length):
            each = room // length
            for held, times in list(by_room[room].items()):
                full = min(times, n // each)
                some = n - full * each if full < times and 0 < n - full * each < each else 0
                rest = times - full - bool(some)
                if full or some:
                    by_room[room].pop(held)
                    add(room, held, rest)
                    add(room - each * length, (*held, (length, each)), full)
                    add(room - some * length, (*held, (length, some)), int(bool(some)))
                    n -= full * each + some
                if not n:
                    break
            if not n:
                break
        each = capacity // length
        add(capacity - each * length, ((length, each),), n // each)
        add(capacity - n % each * length, ((length, n % each),), int(n % each > 0))
    return [(held, n) for slot in by_room.values() for held, n in slot.items()]


def sequences(planned: list[tuple[Contents, int]]) -> int:
    return sum(times for _, times in planned)


def plan(count: np.ndarray, capacity: int = SEQUENCE) -> tuple[list[tuple[Contents, int]], float]:
    """Configurations and how often each, that hold the histogram ``count`` exactly, and the program's lower bound.

    The heat falls fast while the weights cover all lengths alike and slowly otherwise.  The
    fractional solution is rounded now and then, and the plan of fewest sequences stays; it
    ends within TIGHT of the bound, or after ROUNDS pricings.
    """
    left = count.astype(np.int64).copy()
    out: list[tuple[Contents, int]] = [(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    if not left.any():
        return out, float(sequences(out))
    pool, heat, found = Configurations(left, capacity), HOT, best_fit(left, capacity)
    for k in range(1, ROUNDS + 1):
        pool.extend()
        heat = max(heat * (0.5 if pool.reweigh(heat) < 0.01 else 0.95), COLD)
        if k % ROUNDED == 0:
            found = min(found, pool.rounded(left), key=sequences)
            if sequences(found) <= max(np.ceil(pool.bound - 1e-6), (1 + TIGHT) * pool.bound):
                break
        pool.prune()
    return out + found, pool.bound + sequences(out)


def places(planned: list[tuple[Contents, int]]) -> dict[str, np.ndarray]:
    """Slots by length: from which rank a run of slots begins, its first sequence, slots per sequence and first offset."""
    rows, base, upto = [], 0, {}
    for held, times in planned:
        offset = 0
        for length, n in sorted(held, reverse=True):
            rows.append((length, upto.get(length, 0), base, n, offset))
            upto[length] = upto.get(length, 0) + n * times
            offset += n * length
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "base", "n", "offset"), cols))


def pack(cut_pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``cut_pieces`` (a written table of ``pieces``) with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    counts = cut_pieces.groupBy("length", "chunk").agg((F.max("nth") + 1).alias("n"))
    counts = cut(counts, "counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(sequence + 1, np.int64)
    count[histogram["length"].to_numpy(int)] = histogram["n"].to_numpy(int)
    sent = spark.sparkContext.broadcast(places(plan(count, sequence)[0]))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    before = cut(counts.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before")), "before")
    kept = [c for c in cut_pieces.columns if c not in {"chunk", "nth"}]
    ranked = cut_pieces.join(small(before, 24), ["length", "chunk"]).select(*kept, (F.col("nth") + F.col("before")).cast("long").alias("rank"))

    def run(batches):
        p = sent.value
        keys = (p["length"] << 44) + p["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            inner = rank - p["rank"][k]
            where = [pa.array(p["base"][k] + inner // p["n"][k]), pa.array(p["offset"][k] + inner % p["n"][k] * length)]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, *where], [*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {cut_pieces.schema[c].dataType.simpleString()}" for c in kept)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """All pieces of ``docs`` with their places; the texts are tokenised once."""
    return pack(cut(pieces(docs, tokenizer, sequence, with_ids), "pieces"), sequence)


def production_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs, production_tokenizer())
