"""Line dedup, decontamination and URL filter against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, line_dedup, url_filter

LONG = " ".join(f"w{i}" for i in range(30))


def brute_lines(pairs, min_words):
    """Texts after deletion: every run of whole lines with enough words that has an earlier copy goes."""
    order = sorted({p for p in pairs if p[1] is not None}, key=lambda p: (p[0] is not None, p[0] or 0))
    seen, gone = set(), {}
    for doc in order:
        lines = [(i, x) for i, x in enumerate(doc[1].split("\n")) if re.search(r"\S", x)]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for _, x in lines[a:b]) >= min_words:
                    key = tuple(x for _, x in lines[a:b])
                    if key in seen:
                        gone.setdefault(doc, set()).update(i for i, _ in lines[a:b])
                    seen.add(key)
    return {p: None if p[1] is None else "\n".join(x for i, x in enumerate(p[1].split("\n")) if i not in gone.get(p, ())) for p in pairs}


LINES = [
    (1, "a b c\nd e\nf g h i\n\nunique one"),
    (2, "other start\na b c\nd e\nf g h i\nend"),
    (3, "d e\nf g h i"),
    (4, "same\nsame\nsame\nsame\nsame\nsame\nsame"),
    (5, None),
    (6, ""),
    (7, "\n\n"),
    (8, "a b c\n\nd e\nf g h i\n\nunique one"),
    (9, "a b c\nd e\nf g h i\n\nunique one"),
    (9, "a b c\nd e\nf g h i\n\nunique one"),
    (None, "only here f\nf g h i"),
    (10, "\n".join(f"line number {i}" for i in range(200))),
    (11, "\n".join(f"line number {i}" for i in range(50, 250))),
]


@pytest.mark.parametrize("min_words", [1, 4, 6, 20])
def test_line_dedup_like_brute_force(docs, min_words):
    out = line_dedup.line_dedup(docs(LINES).withColumn("n_lines", F.lit(-1)), min_words)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "text", "n_lines", "n_deleted"]
    want = brute_lines(LINES, min_words)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted(((p[0], want[p]) for p in LINES), key=repr)


def test_line_dedup_of_very_long_texts(docs):
    shared = [f"shared {i} x" for i in range(3000)]
    pairs = [(1, "\n".join(["start of one", *shared, "end of one"])), (2, "\n".join([*(f"own {i}" for i in range(2000)), *shared[500:]])), (3, "word " * 200_000), (4, "word " * 200_000)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs(pairs)).collect()}
    assert got[1] == pairs[0][1] and got[2] == "\n".join(f"own {i}" for i in range(2000))
    assert got[3] == pairs[2][1] and got[4] == ""


def brute_maximal(pairs, min_words):
    """Later copies of runs by comparing all places: the least earlier place of each long enough run, merged along equal distances."""
    order = sorted({p for p in pairs if p[1] is not None}, key=lambda p: (p[0] is not None, p[0] or 0))
    first, found = {}, {}
    for doc in order:
        lines = [x for x in doc[1].split("\n") if re.search(r"\S", x)]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= min_words:
                    at = first.setdefault(tuple(lines[a:b]), (doc[0], a))
                    if at != (doc[0], a):
                        found.setdefault((doc[0], at[0], a - at[1]), set()).update(range(a, b))
    return found


def test_maximal_runs_like_brute_force(docs):
    pairs = list(dict.fromkeys(LINES))
    _, held = line_dedup.intervals(docs(pairs), 6)
    rows = line_dedup.maximal_runs(held).collect()
    want = brute_maximal(pairs, 6)
    assert rows and max(r.n for r in rows) == 150
    for r in rows:
        assert set(range(r.p, r.p + r.n)) <= want[(r.doc_id, r.source_id, r.p - r.source_p)]
    got, every = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, set()).update(range(r.p, r.p + r.n))
    for (doc_id, _, _), places in want.items():
        every.setdefault(doc_id, set()).update(places)
    assert got == every


def test_line_dedup_of_nothing(docs):
    assert line_dedup.line_dedup(docs([(1, "x")]).where("false")).count() == 0


def test_hot_line_in_many_documents(docs):
    pairs = [(i, f"{LONG}\nown {i}") for i in range(300)]
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(docs(pairs)).collect()}
    assert out[0] == pairs[0][1] and all(out[i] == f"own {i}" for i in range(1, 300))


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(pairs, items, width, min_items):
    out = []
    for doc_id, text in pairs:
        w, hit, found, near = tokens(text), set(), set(), set()
        for item_id, item in items:
            v = tokens(item)
            for j in range(max(1, len(v) - width + 1)) if v else ():
                x = v[j : j + width]
                if any(set(x) <= set(w[s : s + 2 * len(x)]) for s in range(len(w))):
                    near.add(item_id)
                for s in range(len(w) - len(x) + 1):
                    if w[s : s + len(x)] == x:
                        hit.update(range(s, s + len(x)))
                        found.add(item_id)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        n = len(found - {None})
        out.append((doc_id, len(w), len(hit), n, hashlib.sha256(ids.encode()).hexdigest(), n >= min_items, len(near - {None})))
    return sorted(out, key=repr)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again"), (2, "Éclair été; ÉCOLE"), (3, "single"), (4, ""), (5, None), (None, "nobody named this"), (11, "the quick brown fox jumps over the lazy cat"), (2, "a second text of item two"), (15, "the the the")]
TEXTS = [
    (1, "x THE QUICK brown, fox jumps over the lazy dog y"),
    (2, "the quick brown fox jumps over the lazy dog again; the quick brown fox jumps over the lazy cat. Éclair été ÉCOLE"),
    (3, "éclair été école"),
    (4, None),
    (5, ""),
    (6, "a single word"),
    (None, "single nobody named this"),
    (7, "a second text of item two two"),
    (7, "a second text of item two two"),
    (8, "filler " * 5000 + "the quick brown fox jumps over the lazy dog"),
    (9, "the the the quick quick brown"),
    (10, "fox the quick jumps brown over x y the lazy dog z"),
    (12, "lazy the dog over and under the jumps of a quick fox brown again " * 3),
    (13, "été éclair x y école single"),
    (14, "the the the the"),
]


@pytest.mark.parametrize("width", [3, 8])
def test_decontamination_like_brute_force(spark, docs, width):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.decontaminate(docs(TEXTS), items, width, 2)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]
    assert sorted((tuple(r) for r in out.select(*cols).collect()), key=repr) == brute_hits(TEXTS, ITEMS, width, 2)


def test_decontamination_without_items_or_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_items for r in decontaminate.decontaminate(docs([(1, "a b")]), none).collect()] == [0]
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.decontaminate(docs([(1, "a")]).where("false"), some).count() == 0


def test_hit_words_are_cut_out(spark, docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "a b c d e f g h")], "item_id long, text string")
    texts = [(1, "Before: One two three, four five six seven eight. After"), (2, "a b c d e f g h one two three four five six seven eight"), (3, "clean text"), (4, None)]
    out = {r.doc_id: r.text for r in decontaminate.clean(docs(texts), items).collect()}
    assert out == {1: "Before. After", 3: "clean text", 4: None}


def test_columns_with_names_of_the_operator_stay(spark, docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    frame = docs([(1, "Before: one two three four five six seven eight. After"), (2, "clean")])
    for name in ("spans", "contaminated", "hit_id", "doc_hash", "n", "pos"):
        frame = frame.withColumn(name, F.lit("own"))
    out = decontaminate.clean(frame, items)
    assert out.columns == frame.columns and {(r.doc_id, r.text, r.spans, r.n, r.doc_hash) for r in out.collect()} == {(1, "Before. After", "own", "own", "own"), (2, "clean", "own", "own", "own")}


def test_proximity(spark, docs):
    windows = spark.createDataFrame([(1, ["red", "fox", "runs"])], "window_id long, window array<string>")
    texts = docs([(1, "red fox x x runs x"), (2, "fox runs x x x x x x x x x red fox"), (3, "red fox runs"), (4, "red x x x x x runs fox"), (5, "fox runs red red fox runs")])
    index = decontaminate.PositionalIndex(texts, windows)
    matches = index.matches(windows)
    name = {r.n: r.doc_id for r in index.documents().collect()}
    assert sorted(name[r.n] for r in decontaminate.proximity_matches(matches).collect()) == [1, 3, 5]
    assert sorted((name[r.n], r.start) for r in decontaminate.phrase_matches(matches).collect()) == [(3, 0), (5, 3)]


def test_wide_windows(spark, docs):
    item = " ".join(f"u{i % 90}" for i in range(100))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [(1, f"before {item} after"), (2, item.replace("u77", "other"))]
    out = decontaminate.decontaminate(docs(texts), items, 100, 1)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]
    assert sorted(tuple(r) for r in out.select(*cols).collect()) == brute_hits(texts, [(1, item)], 100, 1)


URLS = [
    (1, "http://www.EXAMPLE.com/en/x?y#z"), (2, "https://m.example.com/en/"), (3, "https://example.com/EN/"), (4, "ftp://a.net/es/1"), (5, "x://net/fr/"),
    (6, "http://a.com"), (7, None), (8, "no scheme"), (9, "http://" + "a." * 3000 + "net/es/" + "b" * 5000), (10, "http://badnet/es/"), (10, "http://badnet/es/"), (None, "http://x.com/?q"),
    (11, ""), (12, "://"), (13, "http://a.net/es"), (14, "http://É.COM/"),
]


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")


def test_urls_like_brute_force(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = url_filter.url_verdicts(pages, url_filter.rule_table(spark, url_filter.RULES))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(((i, *brute_url(u, url_filter.RULES)) for i, u in URLS), key=repr)


def test_urls_with_equal_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    both = url_filter.rule_table(spark, [("b", "/c", "allow"), ("b", "/c", "block"), ("b", "/", "allow")])
    assert url_filter.url_verdicts(pages, both).first().verdict == "block"
    assert url_filter.url_verdicts(pages, both.where("false")).first().verdict == "allow"
    assert url_filter.url_verdicts(pages.where("false"), both).count() == 0


def test_no_python_in_native_plans(spark, docs):
    out = line_dedup.line_dedup(docs(LINES))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    urls = url_filter.url_verdicts(spark.createDataFrame(URLS, "page_id long, url string"), url_filter.rule_table(spark, url_filter.RULES))
    for df in (out, decontaminate.decontaminate(docs(TEXTS), items), urls):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
