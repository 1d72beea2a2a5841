"""Packing and ZIP-packaged WARC: exact round trips."""

import base64
import gzip
import hashlib
import io
import itertools
import json
import struct
import zipfile
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import packing, warc_zip

TOKENIZER = packing.production_tokenizer()


@lru_cache(1)
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def reference_ids(text):
    return reference().encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


TEXTS = [(1, "Hello wörld, it's 42!\n\n  x"), (2, None), (3, ""), (4, "word " * 3000), (5, "Ünï çödé " * 500), (5, "Ünï çödé " * 500), (None, "no id"), (6, "a" * 5000), (7, "it's\tmine  now 'llama  \r\n" * 40), (8, "x½ Ⅷ 2² a\x1cb \x1f c_d __ ا٣ ​ e\u0301 \u00a0\u3000 z\x85 日本語 七"), (9, "tab\x1c \x1d x"), (10, "😀👍🏽 ok \ufffd")]
TEXTS += [(11, "a<|endoftext|>b"), (12, "<|endoftext|>"), (13, "one  <|endoftext|> \n<|endoftext|><|endoftext|>two <|endoftext| >"), (14, "many words <|endoftext|> é 42" * 400)]


def test_tokens_of_long_texts_do_not_depend_on_splitting(monkeypatch):
    words = packing._words(TOKENIZER)
    monkeypatch.setattr(packing, "SPLIT", 50)
    for _, text in TEXTS:
        assert np.frombuffer(packing.token_bytes(text or "", words), "<u4").tolist() == reference_ids(text)


@pytest.mark.parametrize("parts", [1, 7])
def test_pieces_fill_sequences_without_gaps(docs, parts):
    texts = TEXTS + [(100 + i, "some words " * (i % 40)) for i in range(300)]
    frame = docs(texts, repartition=parts).withColumn("length", F.lit("clash")).withColumn("chunk", F.lit(1)).withColumn("rank", F.lit(0))
    rows = packing.packed(frame, TOKENIZER, with_ids=True).collect()
    ids = {i: reference_ids(t) for i, t in texts}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == own and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and 0 < r.length <= 1024
        assert r.length == 1024 or r.piece == 0
    assert sum(r.length for r in rows) == sum(len(ids[i]) for i, _ in texts)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_packing_nothing(docs):
    assert packing.packed(docs([(1, "x")]).where("false"), TOKENIZER).count() == 0


def held_by(planned, capacity):
    count = np.zeros(capacity + 1, np.int64)
    for contents, times in planned:
        assert sum(length * n for length, n in contents) <= capacity and times > 0
        for length, n in contents:
            count[length] += n * times
    return count


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_the_histogram(seed):
    rng = np.random.default_rng(seed)
    count = np.bincount(rng.integers(1, 101, rng.integers(0, 3000)), minlength=101)
    planned, bound = packing.plan(count, 100)
    used = packing.sequences(planned)
    assert (held_by(planned, 100) == count).all() and bound - 1e-6 <= used
    assert used <= packing.sequences(packing.best_fit(count, 100)) and used <= 1.01 * bound + 1


def brute_bound(count, capacity):
    """The program's optimum by the simplex method with every configuration listed, in exact fractions."""
    from fractions import Fraction

    lengths = [int(x) for x in np.nonzero(count)[0]]
    columns = [c for c in itertools.product(*(range(capacity // x + 1) for x in lengths)) if 0 < sum(a * x for a, x in zip(c, lengths)) <= capacity]
    m = len(lengths)
    basis = [tuple(int(i == j) for i in range(m)) for j in range(m)]
    table = [[Fraction(int(i == j)) for j in range(m)] + [Fraction(int(count[lengths[i]]))] for i in range(m)]
    while True:
        dual = [sum(table[i][j] for i in range(m)) for j in range(m)]
        enters = max(columns, key=lambda c: sum(a * y for a, y in zip(c, dual)))
        if sum(a * y for a, y in zip(enters, dual)) <= 1:
            return float(sum(row[-1] for row in table))
        step = [sum(table[i][j] * enters[j] for j in range(m)) for i in range(m)]
        r = min((i for i in range(m) if step[i] > 0), key=lambda i: table[i][-1] / step[i])
        table[r] = [v / step[r] for v in table[r]]
        for i in range(m):
            if i != r:
                table[i] = [v - step[i] * w for v, w in zip(table[i], table[r])]
        basis[r] = enters


@pytest.mark.parametrize("held", [{9: 40, 7: 33, 5: 51, 4: 70}, {11: 20, 8: 90, 6: 45, 3: 20}, {13: 31, 7: 64, 6: 77}, {10: 17, 9: 23, 5: 12, 2: 8}])
def test_bound_and_plan_against_the_program_with_all_configurations(held):
    count = np.zeros(21, np.int64)
    count[list(held)] = list(held.values())
    optimum = brute_bound(count, 20)
    planned, bound = packing.plan(count, 20)
    assert optimum * 0.99 <= bound <= optimum + 1e-6
    assert optimum - 1e-6 <= packing.sequences(planned) <= optimum + len(held)


@pytest.mark.parametrize("low, high", [(20, 300), (345, 512)])
def test_lengths_of_a_narrow_range_are_packed_by_configurations(low, high):
    count = np.zeros(1025, np.int64)
    count[low:high] = np.random.default_rng(low).integers(100, 5000, high - low)
    pool = packing.Configurations(count, 1024)
    pool.extend(), pool.reweigh(packing.HOT)
    assert len(pool.x) > 100 and pool.x.sum() > 0.2 * pool.bound
    planned, bound = packing.plan(count)
    assert packing.sequences(planned) <= 1.0006 * bound + 1 and (held_by(planned, 1024) == count).all()


PAGES = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, "http://a/\r\n3", None), (4, None, ""), (5, "http://a/5", "x" * 300_000), (None, "http://a/n", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (6, "u", "single"), (None, "v", "lone"), (7, "w", "\r\n\r\nodd")]


def brute_pages(rows, least=0):
    out, heads = [], {}
    for i, _, html in rows:
        if i is not None:
            heads[html or ""] = max(heads.get(html or "", i), i)
    for i, _, html in rows:
        body = (html or "").encode()
        same = sum((h or "") == (html or "") for _, _, h in rows) > 1 and len(body) >= least
        head = heads.get(html or "") if same else None
        revisit = head is not None and i != head
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


def test_pages_like_brute_force(spark, tables):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    out = warc_zip.query(spark, tables(pages=pages))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_pages(PAGES)


def test_payloads_come_back_from_many_small_packages(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<b>{i % 150}</b>" * (i % 30)) for i in range(400)], "page_id long, url string, html string").repartition(3)
    packages = warc_zip.write_archives(pages, min_bytes=20, archive_bytes=2_000)
    assert packages.count() > 5
    rows = warc_zip.read_archives(packages).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == 400
    for r in rows:
        own = html[int(r.record_id[len("<urn:page:") : -1])].encode()
        assert r.payload_bytes == len(own) and r.payload == (own if r.record_type == "response" else b"")
        assert len(own) >= 20 or r.record_type == "response"


def test_no_pages(spark, tables):
    assert warc_zip.query(spark, tables(pages=spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_plans_do_not_grow_with_the_number_of_pieces():
    rng = np.random.default_rng(8)
    count = np.concatenate([[0], rng.integers(0, 50_000_000, 100)])
    planned, bound = packing.plan(count, 100)
    assert len(planned) < 20_000 and packing.sequences(planned) <= 1.001 * bound
    wide = np.zeros(101, np.int64)
    wide[[60, 55]] = 10**9
    assert packing.sequences(packing.plan(wide, 100)[0]) == 2 * 10**9


@pytest.mark.parametrize("held, least", [({400: 6000, 300: 12000}, 6000), ({300: 6000, 212: 6000}, 3000), ({400: 7, 300: 14}, 7), ({300: 60, 212: 60}, 30), ({350: 900, 330: 900, 344: 900}, 900), ({600: 1000, 412: 1000, 100: 5000}, 1500), ({508: 600, 258: 600, 234: 1200, 266: 600}, 900)])
def test_plans_of_few_lengths_are_optimal(held, least):
    count = np.zeros(1025, np.int64)
    count[list(held)] = list(held.values())
    planned, bound = packing.plan(count)
    assert (held_by(planned, 1024) == count).all() and packing.sequences(planned) == least and 0.999 * least - 1 <= bound <= least + 1e-6


def test_zip64_directories():
    data, name = b"stored bytes", b"m.bin"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 5)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    body = b"junk!" + local + data
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(body))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(body) + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 4) + b"note"
    whole = body + entry + end64 + locator + end
    at, n, method = warc_zip.zip_members(io.BytesIO(whole), len(whole))["m.bin"]
    assert whole[at : at + n] == data and method == 0


def raw_record(kind, n, body, more="", http=""):
    inner = (f"HTTP/1.1 200 OK\r\n{http}\r\n".encode() + body) if http else body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{n}>\r\n{more}Content-Type: {'application/http' if http else 'text/plain'}\r\nContent-Length: {len(inner)}\r\n\r\n"
    return head.encode() + inner + b"\r\n\r\n"


def foreign(tmp_path, archives, indexes, method=zipfile.ZIP_STORED, name="f.wacz", zip64=False):
    """A package as others write it: archives and indexes by name; indexes may be deflated."""
    with zipfile.ZipFile(tmp_path / name, "w") as z:
        for k, v in archives.items():
            with z.open(zipfile.ZipInfo(f"archive/{k}"), "w", force_zip64=zip64) as out:
                out.write(v)
        for k, v in indexes.items():
            z.writestr(f"indexes/{k}", v, method)
    return f"file://{tmp_path}/{name}"


def lines(name, records, form="com,x)/ 20200101000000 {}"):
    at, out = 0, []
    for r in records:
        out.append(form.format('{"url": "http://x.com/", "filename": "%s", "offset": "%d", "length": "%d"}' % (name, at, len(r))))
        at += len(r)
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_of_other_writers(spark, tmp_path, zip64):
    chunked = b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n"
    one = [raw_record("warcinfo", 1, b"software: x"), raw_record("response", 2, chunked, "WARC-Payload-Digest: sha1:" + warc_zip.digest(b"abcde") + "\r\n", "Transfer-Encoding: chunked\r\n")]
    two = [gzip.compress(raw_record("resource", 3, b"plain", "WARC-Payload-Digest: sha256:" + hashlib.sha256(b"plain").hexdigest() + "\r\n")), gzip.compress(raw_record("revisit", 4, b"", http="Content-Length: 77\r\n"))]
    at = 0
    cdx = " CDX N b a m s k r M S V g\n"
    for r in two:
        cdx += f"com,x)/ 2020 http://x.com/ text/html 200 AAA - - {len(r)} {at} more/b.warc.gz\n"
        at += len(r)
    archives = {"a.warc": b"".join(one), "more/b.warc.gz": b"".join(two)}
    path = foreign(tmp_path, archives, {"a.cdxj": lines("a.warc", one), "b.cdx.gz": gzip.compress(cdx.encode()), "again.cdxj": lines("a.warc", one), "b.idx": "ignored"}, zipfile.ZIP_DEFLATED, zip64=zip64)
    rows = {r.record_id: r for r in warc_zip.read_archives(spark.createDataFrame([(path,)], "path string")).collect()}
    assert {k: (r.record_type, r.payload, r.payload_bytes) for k, r in rows.items()} == {
        "<urn:x:1>": ("warcinfo", b"software: x", 11), "<urn:x:2>": ("response", b"abcde", 5), "<urn:x:3>": ("resource", b"plain", 5), "<urn:x:4>": ("revisit", b"", 77),
    }


def located(path):
    data = open(path.removeprefix("file://"), "rb").read()
    return list(warc_zip.located(io.BytesIO(data), len(data)))


def test_packages_that_cannot_be_read_by_ranges_are_errors(tmp_path):
    r = [raw_record("resource", 1, b"x")]
    for archives, indexes in (({"a.warc": r[0]}, {}), ({}, {"a.cdxj": lines("a.warc", r)}), ({"a.warc": r[0][:20]}, {"a.cdxj": lines("a.warc", r)}), ({"a.warc": r[0]}, {"a.cdx": "too few fields"})):
        with pytest.raises(ValueError):
            located(foreign(tmp_path, archives, indexes))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/a.warc", r[0] * 50, zipfile.ZIP_DEFLATED)
        z.writestr("indexes/a.cdxj", lines("a.warc", r))
    with pytest.raises(ValueError, match="not stored"):
        list(warc_zip.located(io.BytesIO(out.getvalue()), len(out.getvalue())))
    with pytest.raises(ValueError):
        warc_zip.zip_members(io.BytesIO(b"nothing"), 7)


def test_slices_end_at_gaps(tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zip, "GAP_BYTES", 100)
    records = [raw_record("resource", i, b"x" * (300 if i == 2 else 5)) for i in range(4)]
    listed = "".join(x + "\n" for i, x in enumerate(lines("a.warc", records).splitlines()) if i != 2)
    assert [len(held) for _, held in located(foreign(tmp_path, {"a.warc": b"".join(records)}, {"a.cdxj": listed}))] == [2, 1]


def test_a_wrong_digest_is_an_error():
    headers, payload, _ = warc_zip.parse(raw_record("resource", 1, b"x", "WARC-Payload-Digest: sha1:AAAA\r\n"))
    with pytest.raises(ValueError):
        warc_zip.checked(headers, payload)


def test_own_packages_follow_the_format(spark):
    pages = spark.createDataFrame([(1, "http://Sub.Example.com/A b", "<p>1</p>"), (2, None, "<p>1</p>")], "page_id long, url string, html string").repartition(1)
    path = warc_zip.write_archives(pages).first().path
    found, inner = warc_zip._open(path)
    with zipfile.ZipFile(io.BytesIO(found.open_input_file(inner).read())) as z:
        about = json.loads(z.read("datapackage.json"))
        for r in about["resources"]:
            data = z.read(r["path"])
            assert r["bytes"] == len(data) and r["hash"] == "sha256:" + hashlib.sha256(data).hexdigest()
        keys = [line.split(" ", 2) for line in z.read("indexes/index.cdxj").decode().splitlines()]
        assert [k[:2] for k in keys] == [["-", "20200101000000"], ["com,example,sub)/a%20b", "20200101000000"]] and all(json.loads(k[2])["filename"] == "data.warc.gz" for k in keys)
