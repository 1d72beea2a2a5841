"""Benchmark decontamination by a positional inverted index over the training text.

The index holds a posting (row, term, position) for every occurrence of a word of the test
windows in the documents; it is written once, each partition's lists sorted by term.  Words
that no window has are never looked up and have no list.

A window is found from its rarest words on.  The list of its rarest word, and that of the next
rarest, are intersected first, once for all windows that share the two; a place stays if the
second list has a posting near enough.  Then the lists of the window's other words follow one
by one, rarest first, each over the places that are left.  At a place where all words of the
window have postings, the positions less the words' offsets in the window decide: if all agree
on a start, it is an exact phrase match; if all lie in a stretch of at most ``NEAR`` times the
window's words, in any order, it is a proximity match (exact matches are such, too).

Everything is DataFrame operations.  Lists are joined by row, word and strip of positions, so
neither a common word nor a very long document is one key.

Defined cases: every row is a document of its own, so repeated rows get equal results; null
text has no words; very long texts are indexed whole; an item without words has no window;
items that share a window, or an item id that comes twice, count by id; a null item_id counts
for hits but not as an item.  Empty tables give empty (or all-clean) results, and further
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.scratch import cut, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters beyond ASCII that lower() may change; texts with one are lower-cased by a table of A-Z.
ODD_UPPER = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"

#: Consecutive words of a test window.
WINDOW = 8
#: A proximity match holds a window's words in a stretch of so many times its words at most.
NEAR = 2
#: Lists of a window that are intersected one by one; the others follow together, over the few places left.
LISTS = 8
#: Items whose windows a contaminated document holds, at least.
MIN_ITEMS = 2


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(text.rlike(ODD_UPPER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, GAP, -1), "")


def test_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """window (array of words), item_id: each window of each item once."""
    listed = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return listed.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("window")).distinct()


class PositionalIndex:
    """Postings in ``docs`` (doc_id, text) of the words of ``windows`` (arrays of words).

    terms: term_id, word.  postings: n, term_id, pos, and doc_id, doc_hash in the posting of
    term 0, which stands behind a document's last word, so that it holds the number of its words.
    """

    def __init__(self, docs: DataFrame, windows: DataFrame):
        spark = docs.sparkSession
        found = windows.select(F.explode("window").alias("word")).distinct()
        end = spark.createDataFrame([(0, "")], "term_id long, word string")
        self.terms = cut(found.select((F.monotonically_increasing_id() + 1).alias("term_id"), "word").unionByName(end), "terms")
        keyed = small(self.terms.select("term_id", F.col("word").alias("term"), F.xxhash64("word").alias("key")), 96)

        listed = F.concat(words(F.col("text")), F.array(F.lit("")))
        held = docs.select(F.monotonically_increasing_id().alias("n"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_hash"), listed.alias("w"))
        # The outer form, as the plain one would compute the words once more to look for empty arrays; there are none.
        tokens = held.select("n", "doc_id", "doc_hash", F.posexplode_outer("w").alias("pos", "word")).withColumn("key", F.xxhash64("word"))
        # The digests meet by an equi-join on one long; the words themselves are compared after it.
        same = F.startswith("word", F.col("term")) & F.startswith(F.col("term"), F.col("word"))
        at_end = lambda c: F.when(F.col("term_id") == 0, F.col(c)).alias(c)
        posted = tokens.join(keyed, "key").where(same).select("n", "term_id", "pos", at_end("doc_id"), at_end("doc_hash"))
        # Rows come in the order of n and pos; a sort by one long keeps that order within a list.
        self.postings = cut(posted.sortWithinPartitions("term_id"), "postings")
        self.lists = self.postings.where("term_id > 0").select("n", "term_id", "pos")
        self.counts = cut(self.lists.groupBy("term_id").agg(F.count("*").alias("df")), "counts")

    def documents(self) -> DataFrame:
        """n, doc_id, doc_hash, n_words: a row for each row of the input."""
        return self.postings.where("term_id = 0").select("n", "doc_id", "doc_hash", F.col("pos").cast("long").alias("n_words"))

    def _by_rarity(self, windows: DataFrame) -> DataFrame:
        """window_id, size, span, slots (offset, term_id), terms (distinct, rarest first), k (their number), t1, t2.

        Windows with a word that no document has are gone; t2 is null where k is 1.
        """
        spread = windows.select("window_id", F.size("window").alias("size"), F.posexplode("window").alias("offset", "word"))
        known = spread.join(self.terms, "word").join(self.counts, "term_id")
        ranked = known.groupBy("window_id", "size").agg(
            F.sort_array(F.collect_list(F.struct("offset", "term_id"))).alias("slots"), F.sort_array(F.collect_set(F.struct("df", "term_id"))).alias("lists")
        )
        terms = F.transform("lists", lambda x: x["term_id"])
        ranked = ranked.where(F.size("slots") == F.col("size")).select("window_id", "size", (F.col("size") * NEAR).alias("span"), "slots", terms.alias("terms"), F.size("lists").alias("k"))
        return ranked.withColumn("t1", F.get("terms", F.lit(0))).withColumn("t2", F.get("terms", F.lit(1)))

    def _places(self, ranked: DataFrame, strip: int) -> DataFrame:
        """n, window_id, p: places of each window's rarest word that have its next rarest near by."""
        pairs = small(ranked.where("k > 1").select("t1", "t2", "span").distinct(), 32)
        a = self.lists.join(pairs, F.col("term_id") == F.col("t1")).select("n", F.col("pos").alias("p"), "t1", "t2", "span").withColumn("strip", F.explode(_strips(strip)))
        seconds = small(pairs.select(F.col("t2").alias("term_id")).distinct(), 16)
        b = self.lists.join(seconds, "term_id", "left_semi").select("n", F.col("term_id").alias("t2"), "pos", F.floor(F.col("pos") / strip).alias("strip"))
        near = a.join(b, ["n", "t2", "strip"]).where(F.abs(F.col("p") - F.col("pos")) < F.col("span")).select("n", "p", "t1", "t2", "span").distinct()
        found = near.join(ranked.select("window_id", "t1", "t2", "span"), ["t1", "t2", "span"]).select("n", "window_id", "p")
        single = self.lists.join(small(ranked.where("k = 1").select("window_id", "t1"), 24), F.col("term_id") == F.col("t1")).select("n", "window_id", F.col("pos").alias("p"))
        return cut(found.unionByName(single), "places")

    def matches(self, windows: DataFrame) -> DataFrame:
        """n, window_id, size, p, near, starts: places of the rarest words of ``windows`` (window_id, window) with a proximity match, and the starts of exact ones."""
        ranked = cut(self._by_rarity(windows), "ranked")
        most = ranked.agg(F.max("k").alias("k"), F.max("span").alias("span")).first()
        strip = 4 * (most["span"] or 1)
        held_by = small(ranked.select("window_id", "size", "span", "terms", "k", "slots"), 512)
        left = self._places(ranked, strip).join(held_by, "window_id")
        # Of the other lists only what lies in a strip with a place, or next to one, is looked at.
        spots = cut(left.select("n", F.explode(_strips(strip)).alias("strip")).distinct(), "spots")
        lists = self.lists.withColumn("strip", F.floor(F.col("pos") / strip)).join(small(spots, 24), ["n", "strip"], "left_semi")
        lists = cut(lists, "lists")
        for r in range(2, min(most["k"] or 0, LISTS)):
            t = F.get("terms", F.lit(r))
            at = F.when(t.isNull(), F.array(F.lit(None).cast("long"))).otherwise(_strips(strip))
            wanted = left.select("*", t.alias("t"), F.explode(at).alias("at")).alias("w")
            met = wanted.join(lists.alias("l"), (F.col("w.n") == F.col("l.n")) & (F.col("t") == F.col("l.term_id")) & (F.col("at") == F.col("l.strip")), "left")
            met = met.where("t IS NULL OR abs(l.pos - p) < span")
            left = met.groupBy("w.n", "window_id", "p").agg(*(F.first(c).alias(c) for c in ("size", "span", "terms", "k", "slots")))
        left = cut(left, "left")

        wanted = left.select("n", "window_id", "p", "span", F.explode("terms").alias("term_id"), _strips(strip).alias("at")).withColumn("strip", F.explode("at")).drop("at")
        around = wanted.join(lists, ["n", "term_id", "strip"]).where(F.abs(F.col("pos") - F.col("p")) < F.col("span"))
        around = around.groupBy("n", "window_id", "p").agg(F.collect_set(F.struct(F.col("pos").cast("int").alias("pos"), "term_id")).alias("found"))
        full = around.join(left, ["n", "window_id", "p"])
        within = lambda s: F.filter("found", lambda y: (y["pos"] >= s) & (y["pos"] < s + F.col("span")))
        near = F.exists("found", lambda x: F.size(F.array_distinct(F.transform(within(x["pos"]), lambda y: y["term_id"]))) == F.col("k"))
        begins = F.transform(F.filter("slots", lambda x: x["term_id"] == F.col("terms")[0]), lambda x: F.col("p") - x["offset"])
        at = lambda s, x: F.struct((s + x["offset"]).cast("int").alias("pos"), x["term_id"].alias("term_id"))
        starts = F.filter(begins, lambda s: F.forall("slots", lambda x: F.array_contains("found", at(s, x))))
        return cut(full.select("n", "window_id", "size", "p", near.alias("near"), starts.alias("starts")).where("near"), "matches")


def _strips(strip: int) -> Column:
    """The strips of positions that lie less than span from p."""
    return F.sequence(F.floor((F.col("p") - F.col("span") + 1) / strip), F.floor((F.col("p") + F.col("span") - 1) / strip))


def phrase_matches(matches: DataFrame) -> DataFrame:
    """n, start, window_id, size of each exact occurrence, from a table of ``PositionalIndex.matches``."""
    return matches.select("n", "window_id", "size", F.explode("starts").alias("start")).distinct()


def proximity_matches(matches: DataFrame) -> DataFrame:
    """n, window_id: the windows whose words stand near each other in a document, from the same table."""
    return matches.select("n", "window_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """doc_id, doc_hash, n_words, n_hit, n_items, items_sha256, contaminated, n_near, spans: a row for each row of ``docs``.

    n_near: items with a proximity match; spans: the hit words as sorted, disjoint [from, to) positions.
    """
    by_item = test_windows(items, width)
    windows = cut(by_item.select("window").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    of_item = by_item.join(windows, "window").select("window_id", "item_id").where("item_id IS NOT NULL")
    index = PositionalIndex(docs, windows)
    matches = index.matches(windows)
    phrases = phrase_matches(matches)

    before = Window.partitionBy("n").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    ends = phrases.groupBy("n", "start").agg(F.max("size").alias("size")).withColumn("end", F.col("start") + F.col("size"))
    ends = ends.withColumn("covered", F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = ends.where("end > covered").groupBy("n").agg(
        F.sum(F.col("end") - F.col("covered")).cast("long").alias("n_hit"),
        F.sort_array(F.collect_list(F.struct(F.col("covered").alias("from"), F.col("end").alias("to")))).alias("spans"),
    )
    of_item = small(cut(of_item, "items"), 32)
    met = lambda windows: windows.select("n", "window_id").distinct().join(of_item, "window_id").select("n", "item_id").distinct()
    named = met(phrases).groupBy("n").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    near = met(proximity_matches(matches)).groupBy("n").agg(F.count("*").alias("n_near"))
    found = cut(hit.join(named, "n", "full").join(near, "n", "full"), "found")
    out = index.documents().join(small(found, 512), "n", "left")
    return out.select(
        "doc_id", "doc_hash", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("ids", F.array().cast("array<string>"))).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_items", F.lit(0)) >= min_items).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "spans",
    )


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words at the positions of ``spans`` and what stands before each of them."""
    held = F.array(F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"), F.split(text, WORD, -1).alias("g")))
    hits = F.flatten(F.transform(spans, lambda s: F.sequence(s["from"], s["to"] - 1)))
    # The one-element array binds the words and gaps, so that they are computed once per text.
    rest = lambda z: F.array_except(F.sequence(F.lit(0), F.size(z["w"])), hits)
    glued = lambda z: F.array_join(F.transform(rest(z), lambda i: F.concat(F.get(z["g"], i), F.coalesce(F.get(z["w"], i), F.lit("")))), "")
    return F.transform(held, glued)[0]


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """``docs`` (doc_id, text and any others) without the contaminated ones, and with the hit words of the others cut out."""
    found = cut(decontaminate(docs.select("doc_id", "text"), items, width, min_items).where("spans IS NOT NULL"), "hits")
    found = found.select(F.col("doc_id").alias("hit_id"), "doc_hash", "contaminated", "spans").dropDuplicates(["hit_id", "doc_hash"])
    right = small(found, 512)
    met = docs.join(right, docs["doc_id"].eqNullSafe(right["hit_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == right["doc_hash"]), "left")
    kept = met.where(~F.coalesce(right["contaminated"], F.lit(False)))
    text = F.when(right["spans"].isNull(), docs["text"]).otherwise(without_spans(docs["text"], right["spans"]))
    return kept.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS size, array_to_string(w[s : s + least(len(w), 8) - 1], ' ') AS phrase
  FROM iw, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS u(s) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows), places AS (
  SELECT n, s, size, array_to_string(w[s : s + size - 1], ' ') AS phrase
  FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM dw, sizes WHERE len(w) >= size)
), matches AS (
  SELECT n, s, places.size, item_id FROM places JOIN windows ON places.phrase = windows.phrase AND places.size = windows.size
), hits AS (
  SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(s, s + size)) AS p FROM matches) GROUP BY n
), items AS (
  SELECT n, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS id FROM matches WHERE item_id IS NOT NULL) GROUP BY n
), terms AS (
  SELECT phrase, size, len(ws) AS k, unnest(ws) AS t
  FROM (SELECT DISTINCT phrase, size, list_distinct(string_split(phrase, ' ')) AS ws FROM windows)
), tokens AS (
  SELECT n, t, p FROM (SELECT n, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM dw) WHERE t IN (SELECT t FROM terms)
), met AS (
  SELECT n, phrase, size, k FROM terms JOIN (SELECT DISTINCT n, t FROM tokens) USING (t) GROUP BY ALL HAVING count(*) = k
), held AS (
  SELECT n, phrase, met.size, met.k, t, p FROM met JOIN terms USING (phrase) JOIN tokens USING (n, t)
), stretches AS (
  SELECT a.n, a.phrase FROM held a JOIN held b ON a.n = b.n AND a.phrase = b.phrase AND b.p BETWEEN a.p AND a.p + 2 * a.size - 1
  GROUP BY a.n, a.phrase, a.p, a.k HAVING count(DISTINCT b.t) = a.k
), nears AS (
  SELECT n, count(DISTINCT item_id) AS n_near FROM (SELECT DISTINCT n, phrase FROM stretches) JOIN windows USING (phrase) GROUP BY n
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN hits ON dw.n = hits.n LEFT JOIN items ON dw.n = items.n LEFT JOIN nears ON dw.n = nears.n
"""
