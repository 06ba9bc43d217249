"""The training-data operators against plain forms: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, components, documents, hits, kept_words, near
from pyspark.sql import functions as F

from skeinflow.llm import decontaminate, kernels, mixing, ngram_join, pii, quality_classifier, quality_rules, sharding, sketches, substring_dedup, url_filters, warc
from skeinflow.llm.components import connected_components

RNG = random.Random(11)
VOCABULARY = ["the", "of", "And", "ab", "cdé", "x1", "foo,", "bar.", "ßen", "zz", "TO", "ünd"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, repeats within a text, spaces of all kinds, empty, null and long ones."""
    rng = random.Random(7)
    base, passage = prose(120, rng), prose(50, rng)
    texts = [None, "", " \t\n", "one", "one two", "One two", base, base, base.upper(), passage, f"{prose(60, rng)} {passage} {prose(9, rng)}", f"{passage}\n\n{prose(70, rng)}"]
    for cut in (1, 3, 5, 30):
        w = base.split()
        for at in rng.sample(range(len(w)), cut):
            w[at] = f"new{at}"
        texts.append("\t".join(w))
    texts += ["a b c d e " * 40, "  ".join(f"w{i}" for i in range(3000)), *(prose(rng.randint(1, 90), rng) for _ in range(20))]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    t = corpus()
    return documents(spark, t, [None if i % 9 == 0 else f"src{min(i % 5, 2)}" for i in range(len(t))]).withColumn("n_words", F.lit("taken")).withColumn("Score", F.lit("taken"))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"_{name}", df.toArrow())
        con.execute(f"create view {name} as select * from _{name}")
    return con.execute(sql).fetchall()


# --- kernels -------------------------------------------------------------------------------------------------------


def test_words_and_windows():
    texts = corpus()
    w = kernels.Words(pa.array(texts))
    import re

    for i, t in enumerate(texts):
        found = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        assert [w.data[a:b].tobytes() for a, b in zip(w.start[w.ptr[i] : w.ptr[i + 1]], w.end[w.ptr[i] : w.ptr[i + 1]], strict=True)] == found
    by_word = {}
    for a, b, h in zip(w.start, w.end, w.hash, strict=True):
        by_word.setdefault(w.data[a:b].tobytes(), set()).add(int(h))
    assert all(len(x) == 1 for x in by_word.values()) and len(set().union(*by_word.values())) == len(by_word)
    for width in (1, 2, 5, 24):
        a = np.arange(40, dtype=np.uint64)[::-1] * 7 % 13
        assert (kernels.sliding(a, width, np.minimum) == [a[i : i + width].min() for i in range(41 - width)]).all()


def test_sketch_loses_no_repeat():
    keys = kernels.mix(np.arange(5000, dtype=np.uint64))
    bitmaps, bits = [np.zeros((1 << 12) // 8, np.uint8) for _ in range(2)], 12
    counts = [np.bincount(sketches.cells(np.concatenate((keys, keys[:100])), r, bits).astype(int), minlength=1 << bits) for r in range(2)]
    bitmaps = [np.packbits(c > 1) for c in counts]
    assert sketches.maybe_repeated(keys[:100], bitmaps, bits).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(300, 400)] + [(i, i + 1) for i in range(500, 560)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*edges, (None, 1), (5, 5)], "a long, b long")).collect()}
    want = components(600, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


LONG = ["0"]
for _ in range(10):
    LONG = LONG + ["1" if x == "0" else "0" for x in LONG]
#: Two words whose hash by any polynomial modulo 2**64 is the same: a Thue-Morse word and its complement.
TWINS = "".join(LONG), "".join("1" if x == "0" else "0" for x in LONG)


#: Two words whose unkeyed hash, by invertible steps of eight bytes, is the same.
STEPS = "abcdefghijklmnop", "pezxw8yrb0m80o27"


def colliding_words(rng, n=1 << 17):
    """Two words of 16 signs with equal unkeyed hashes: the first eight bytes at will, the next eight solved for."""
    signs = np.frombuffer(bytes(range(0x21, 0x7F)), np.uint8)
    first = signs[rng.integers(0, len(signs), (n, 8))].copy().view("<u8")[:, 0]
    begin = kernels.mix(np.full(1, 16, np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(1))
    after = kernels.mix(begin * np.uint64(kernels.LANE) ^ first) * np.uint64(kernels.LANE)
    last = after[0] ^ after ^ np.frombuffer(b"abcdefgh", "<u8")[0]
    ok = np.flatnonzero(np.isin(last.view(np.uint8).reshape(-1, 8), signs).all(1))[:2]
    return tuple((first[i].tobytes() + last[i].tobytes()).decode() for i in ok)


def test_words_that_other_hashes_take_for_equal():
    found = colliding_words(np.random.default_rng(3))
    for a, b in (STEPS, found):
        assert a != b and len(set(kernels.Words(pa.array([a, b])).hash.tolist())) == 1
    for table, lower in ((kernels.SPACED, False), (kernels.ALNUM, True)):
        for pair in (TWINS, STEPS) + ((found,) if table is kernels.SPACED else ()):
            w = kernels.Words(pa.array([*pair]), table, lower, key=kernels.word_key(), halves=2)
            assert len(set(w.hash.tolist())) == len(set(w.hash_2.tolist())) == 2


def test_keyed_hashes():
    words = [f"{'x' * n}{i}" for n in range(140) for i in range(3)] + ["é" * 40, "é" * 41]
    key = kernels.word_key()
    w = kernels.Words(pa.array([" ".join(words), *words]), key=key, halves=2)
    for h in (w.hash, w.hash_2):
        assert len(set(h.tolist())) == len(words) and h[: len(words)].tolist() == h[len(words) :].tolist()
        assert len(set((h >> np.uint64(32)).tolist()) | set((h & np.uint64(0xFFFFFFFF)).tolist())) > len(words)
    assert not set(w.hash.tolist()) & set(w.hash_2.tolist())
    # The same under the same key, whatever stands around a word; another key has nothing in common.
    assert kernels.Words(pa.array(words[::-1]), key=key).hash.tolist() == w.hash[: len(words)][::-1].tolist()
    assert not set(kernels.Words(pa.array(words), key=kernels.word_key()).hash.tolist()) & set(w.hash.tolist())
    # By hand: one half of "abc", a span of one lane.
    f = kernels._factors(key)
    low = int.from_bytes(b"abc", "little")
    sums = [(int(x[0]) + 3 * int(x[1]) + int(x[2]) * low) % (1 << 64) for x in f[:2]]
    assert kernels.Words(pa.array(["abc"]), key=key).hash.tolist() == [sums[0] >> 32 << 32 | sums[1] >> 32]


@pytest.mark.parametrize("pair", [TWINS, STEPS])
def test_twins_stay_apart(spark, pair):
    a, b = pair
    pad = " ".join(f"w{i}" for i in range(34))
    texts = [f"x y {a}", f"x y {b}", f"{pad} {a}", f"{pad} {b}"]
    docs = documents(spark, texts)
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == dict(enumerate(near(texts, 3, 90)[1]))
    assert not any(r.n_removed for r in substring_dedup.remove_repeats(docs).collect())
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()] == [True, False, True, False]


INNER = "s c m r i t g n no id node root text_id n2 a2 oh __i __n __s __c __h __x __y __id __key __set __sid __same __least __leaf __hot __file __row __before __number __text __text_id __spans __hashes __lines __windows __placed __places __t_windows __host_ok __sha __response __rule __node __hit __found __new __size __source_size __target __uses __no __a __at __source __of __in __bucket __again __root size count once more block from".split()


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({n: F.lit("x") for n in INNER})


OPERATORS = {
    "quality": lambda d, spark: quality_classifier.score_quality(d, spark.range(9).selectExpr("id as doc_id", "int(id % 2) as quality")),
    "passages": lambda d, spark: decontaminate.decontaminate(d, spark.createDataFrame([(1, "THE of")], "item_id long, text string"), clean=True),
    "shards": lambda d, spark: sharding.shard_documents(d, 3000),
    "personal": lambda d, spark: pii.find_personal_data(d),
    "hosts": lambda d, spark: quality_rules.judge_quality(d),
    "repeats": lambda d, spark: substring_dedup.remove_repeats(d),
    "near": lambda d, spark: ngram_join.near_duplicates(d),
    "mixture": lambda d, spark: mixing.mix_documents(d, block=16),
    "kinds": lambda d, spark: warc.dedup_kinds(d, "doc_id", "text"),
    "urls": lambda d, spark: url_filters.judge_urls(d.withColumn("url", F.concat(F.lit("http://a.net/es/"), "doc_id")), html="text"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_names_that_operators_use_themselves(spark, docs, clashing, name):
    """Extra columns of whatever names pass through, and what the operator adds is as without them, under names of its own."""
    plain, extra = OPERATORS[name](docs, spark), OPERATORS[name](clashing, spark)
    assert len({c.lower() for c in extra.columns}) == len(extra.columns)
    kept, want = [c for c in clashing.columns if c in extra.columns], [c for c in docs.columns if c in plain.columns]
    assert set(kept) >= {*INNER, *want}
    added = lambda df, given: [c for c in df.columns if c not in given]
    rows = lambda df, given: sorted(str([r["doc_id"], *(r[c] for c in added(df, given))]) for r in df.collect())
    assert rows(extra, kept) == rows(plain, want)
    assert all(r[c] == "x" for r in extra.select(*INNER).collect() for c in INNER)


# --- 1 -------------------------------------------------------------------------------------------------------------


def test_url_verdicts(spark):
    link = lambda u: f'<head><LINK href="{u}" rel="canonical"></head>'
    rows = [
        (1, "http://a.net/es/1", None), (2, "https://B.org/x?utm_source=q", link("http://a.net/es/1")), (3, "https://b.org/x", ""), (4, "http://WWW.Example.com/en/1", None), (5, "http://example.com/en/1", None),
        (6, "http://c.org/", link("http://example.com/en/1")), (7, "http://d.org/", link("https://ok.com/")), (8, "http://d.org/y", link("http://d.org/")), (9, None, None), (10, "no scheme", None), (11, "http://e.net", None),
        (12, "http://f.org/", '<meta http-equiv="refresh" content="0; url=/z">'), (13, "http://f.org/z", link("//g.net/fr/")), (13, "http://f.org/z", link("//g.net/fr/")), (14, "ftp://x.net/es/#a?b", None), (15, "http://d.org/y?ref=1", link("http://h.net/es/2")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = url_filters.judge_urls(pages.withColumn("Host", F.lit(1)))
    got = sorted((r.page_id, r.verdict, r.rule) for r in out.collect())
    want = {1: ("block", "net/es/"), 2: ("block", None), 3: ("block", None), 4: ("allow", "www.example.com/en/"), 5: ("block", "example.com/en/"), 6: ("block", None), 7: ("allow", None), 8: ("allow", None), 9: ("allow", None), 10: ("allow", None), 11: ("allow", None), 12: ("block", None), 13: ("block", None), 14: ("block", "net/es/"), 15: ("allow", None)}
    assert {g[0]: g[1:] for g in got} == want and len(got) == len(rows)
    sql = run_sql(url_filters.ORACLE, pages=pages.distinct())
    assert {r[0]: (r[4], r[3]) for r in sql} == want
    assert {r.host_ for r in out.where("page_id = 4").collect()} == {"www.example.com"}
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("most", [10_000, 0])
def test_edges_that_pages_declare(spark, monkeypatch, most):
    """Both kinds of links of one page, attributes in either order, references of all kinds; rules in the plan or as a table."""
    from urllib.parse import urljoin

    monkeypatch.setattr(url_filters, "MOST_RULES", most)
    both = '<link rel="canonical" href="http://self.org/a/b/page"><meta content="0;url={0}" http-equiv="refresh">'
    page, refs = "http://self.org/a/b/page?q=1", ["next.html", "?p=2", "../up", "./same", "/root/x?y", "//other.org/z", "http://third.org/", "../../../far/", "..", "#here"]
    pages = spark.createDataFrame([(i, f"http://self.org/a/b/page?q={i}", both.format(r)) for i, r in enumerate(refs)], "page_id long, url string, html string")
    edges = {(r.a, r.b) for r in url_filters.alias_edges(pages).collect()}
    for i, r in enumerate(refs):
        url = f"http://self.org/a/b/page?q={i}"
        to = urljoin(url, r)
        assert (url, "http://self.org/a/b/page") in edges and ((url, to) in edges) == (not r.startswith("#"))
    # A self-canonical page whose refresh leads to a blocked one.
    rows = [(1, page, both.format("http://a.net/es/")), (2, "http://b.org/", both.format("sub/").replace("self.org/a/b/page", "b.org/")), (3, "http://b.org/sub/", '<meta http-equiv=refresh content="0;url=//c.net/fr/x">'), (4, None, both), (5, "odd", both.format("x"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    assert {r[0]: r[4] for r in run_sql(url_filters.ORACLE, pages=pages)} == got
    refs = spark.createDataFrame([(i, f"http://self.org/a/b/page?q={i}", both.format(r.replace("http://third.org", "http://t.net/es"))) for i, r in enumerate(refs)], "page_id long, url string, html string")
    assert {tuple(r) for r in url_filters.judge_urls(refs).select("page_id", "host", "path", "rule", "verdict").collect()} == set(run_sql(url_filters.ORACLE, pages=refs))


# --- 2 -------------------------------------------------------------------------------------------------------------


def test_quality_scores_on_held_out_rows(spark, docs):
    rng = random.Random(5)
    good = [prose(rng.randint(20, 80), rng) for _ in range(300)]
    bad = [" ".join(f"{rng.choice(VOCABULARY)}{rng.choice(['***', '###', '$$$'])}" for _ in range(rng.randint(20, 80))) for _ in range(150)]
    texts = good + bad
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(450)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    d = documents(spark, texts)
    out = quality_classifier.score_quality(d, labels).select("doc_id", "held_out", "score", "predicted").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 450 and 100 < len(held) < 200
    assert np.mean([r.predicted == (r.doc_id < 300) for r in held]) > 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert out == quality_classifier.score_quality(d, flipped).select("doc_id", "held_out", "score", "predicted").collect()
    odd = quality_classifier.score_quality(docs, labels)
    assert odd.count() == docs.count() and "Score" in odd.columns and "score_" in odd.columns
    assert quality_classifier.score_quality(empty(spark), labels.limit(0)).count() == 0
    assert {r.score for r in quality_classifier.score_quality(d.limit(3), labels.limit(0)).collect()} == {0.5}


# --- 3 -------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    rows = [(1, "http://a/", "<p>é"), (2, "http://b/", "<p>é"), (3, None, None), (4, "x\r\ny", ""), (5, "http://c/", "z" * 300_000), (6, "http://d/", "<p>é"), (None, "http://e/", "alone!"), (7, "http://f/", "alone!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 1000)
    packages = warc.write_packages(pages, f"file://{tmp_path}/w")
    back = {r.page_id: r for r in warc.read_packages(packages).collect()}
    assert len(back) == len(rows)
    for i, _, html in rows:
        r = back[None if i is None else str(i)]
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.digest_of(body))
        assert (r.record_type, r.refers_to) == (("response", None) if i == max(same) else ("revisit", str(max(same))))
        assert r.payload == (body if r.record_type == "response" else None)
    sizes = {r.page_id: r.record_type for r in warc.read_packages(warc.write_packages(pages, f"file://{tmp_path}/v", least=6)).collect()}
    assert (sizes["1"], sizes["3"], sizes["4"], sizes[None]) == ("response", "response", "response", "revisit")
    assert warc.read_packages(warc.write_packages(pages.limit(0), f"file://{tmp_path}/u")).count() == 0


def test_zip_directories(tmp_path):
    import struct
    import zipfile

    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 in a comment"
        for i in range(66_000):
            z.writestr(f"m/{i}", str(i))
    f = warc.Ranged(path)
    found = warc.members(f)
    assert len(found) == 66_000  # more than 16 bits hold: the ZIP64 directory
    e = found["m/65999"]
    assert f.read(warc.member_start(f, e), e[2]) == b"65999"
    with zipfile.ZipFile(str(tmp_path / "b.zip"), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/x", "y" * 999)
    g = warc.Ranged(str(tmp_path / "b.zip"))
    with pytest.raises(ValueError):
        warc.member_start(g, warc.members(g)["archive/x"])
    (tmp_path / "c.zip").write_bytes(b"nothing" * 9 + struct.pack("<I", 7))
    with pytest.raises(ValueError):
        warc.members(warc.Ranged(str(tmp_path / "c.zip")))


def test_records_are_read_by_range(tmp_path):
    p = warc.Package(f"file://{tmp_path}/one.wacz")
    for i in range(50):
        p.add(str(i), None, warc.record(str(i), None, np.random.default_rng(i).bytes(20_000), "response", None, {}))
    p.close()
    seen = []
    real = warc.Ranged.read

    def counting(self, at, n):
        seen.append(n)
        return real(self, at, n)

    warc.Ranged.read = counting
    try:
        got = list(warc.read_package(f"file://{tmp_path}/one.wacz", {"7", "31"}))
    finally:
        warc.Ranged.read = real
    assert len(got) == 2 and got[0][1] == np.random.default_rng(7).bytes(20_000) and sum(seen) < 150_000


@pytest.mark.parametrize("before", [b"", b"#!/bin/sh stub " * 99])
@pytest.mark.parametrize("many", [1, 70_000])
def test_packages_of_another_writer(spark, tmp_path, before, many):
    """As the format's own tools write them: bare file names, numbers as text, no ids, a gzipped index in blocks, plain records, data before the ZIP."""
    import gzip
    import io
    import json
    import zipfile

    def one(i, body):
        block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://h/{i}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    bodies = [f"page {i} ".encode() * 50 for i in range(6)]
    files, lines = {"data.warc.gz": b"", "plain.warc": b""}, []
    for i, b in enumerate(bodies):
        name = "data.warc.gz" if i % 2 else "plain.warc"
        raw = gzip.compress(one(i, b)) if i % 2 else one(i, b)
        lines.append(f"h)/{i} 20240101 {json.dumps({'url': f'http://h/{i}', 'filename': name, 'offset': str(len(files[name])), 'length': str(len(raw))})}\n".encode())
        files[name] += raw
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, raw in files.items():
            z.writestr(f"archive/{name}", raw)
        z.writestr("indexes/index.cdx.gz", gzip.compress(b"".join(lines[:4])) + gzip.compress(b"".join(lines[4:])))
        z.writestr("indexes/index.idx", b"!meta 0 {}")
        for k in range(many - 1):
            z.writestr(f"pages/{k}", "")
    (tmp_path / "x.wacz").write_bytes(before + out.getvalue())
    uri = f"file://{tmp_path}/x.wacz"
    assert [b for _, b in warc.read_package(uri, index_bytes=100)] == bodies
    assert [b for _, b in warc.read_package(uri, {"3"})] == [bodies[3]]
    if many == 1:
        got = warc.read_packages(spark.createDataFrame([(uri, 6)], "package string, records long")).collect()
        assert sorted((r.url, r.payload_bytes, r.payload_digest, r.record_type) for r in got) == [(f"http://h/{i}", len(b), warc.digest_of(b), "response") for i, b in enumerate(bodies)]


# --- 4 -------------------------------------------------------------------------------------------------------------


def test_fm_index():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, symbols = int(rng.integers(1, 200)), int(rng.integers(1, 6))
        t = rng.integers(0, symbols, n)
        index, phrases = decontaminate.FMIndex(t, symbols, int(rng.integers(1, 9))), rng.integers(0, symbols, (20, int(rng.integers(1, 5))))
        lo, hi = index.search(phrases)
        for k, p in enumerate(phrases):
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == [i for i in range(n - len(p) + 1) if (t[i : i + len(p)] == p).all()]


def test_decontaminate(spark, docs, monkeypatch):
    texts = corpus()
    items = [(1, texts[6]), (22, "THE of"), (3, texts[9]), (None, "one"), (5, None), (6, "..."), (22, "the OF"), (8, prose(12)), (9, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [hits(t, items) for t in texts]
    gen = decontaminate.phrase_blocks
    for blocks, most in ((1 << 20, 1 << 20), (20, 1 << 20), (20, 1), (20, 3000)):
        monkeypatch.setattr(decontaminate, "phrase_blocks", lambda b, i, t, k, key, most=blocks: gen(b, i, t, k, key, most))
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, clean=True, most=most).collect()}
        for i, (n, hit, ids) in enumerate(want):
            r = got[i]
            assert (r.n_words_, sorted(j for a, b in r.hit_spans for j in range(a, b)), r.item_ids, r.contaminated) == (n, sorted(hit), ids, bool(hit))
            assert r.hit_spans == sorted(r.hit_spans) and (r.clean_text == texts[i] if not hit else len(r.clean_text) < len(texts[i]))
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(empty(spark), bench, most=1).count() == 0
    assert gen(bench, "item_id", "text", 10, b"key", 20).count() > 1


# --- 5 -------------------------------------------------------------------------------------------------------------


def test_shards(spark, docs):
    limit = 3000
    out = sharding.shard_documents(docs, limit).collect()
    sums, depth = {}, {}
    for r in out:
        sums[r.shard] = sums.get(r.shard, 0) + r.doc_bytes
        depth[r.shard] = r.shard_depth
    longest = max(len((t or "").encode()) for t in corpus())
    assert len(out) == docs.count() and longest > limit
    assert all(n <= limit or sum(r.shard == s for r in out) == 1 for s, n in sums.items())
    assert all(not a.startswith(b) or a == b for a in sums if "/" not in a for b in sums if "/" not in b)
    small = docs.where("length(text) < 2000 or text is null")
    for n in (500, 2000, 10**9):
        a = {(r.doc_id, r.shard, r.shard_depth, r.shard_bytes, r.doc_bytes) for r in sharding.shard_documents(small, n).collect()}
        if n > 500:
            assert a == set(run_sql(sharding.oracle(n), documents=small.select("doc_id", "text")))
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_rows_of_one_hash_fill_pages(spark):
    rows = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x" * 40).alias("text")).union(spark.range(50).select("id", F.lit("yy")))
    out = sharding.shard_documents(rows, 1000).collect()
    sums = {}
    for r in out:
        sums[r.shard] = sums.get(r.shard, 0) + r.doc_bytes
    assert len(out) == 550 and max(sums.values()) <= 1000 and len(sums) < 40


# --- 6 -------------------------------------------------------------------------------------------------------------


def test_base_spans():
    text = "é a.b+c@x-1.co.uk,q@w @x.y 1.2.3.4.5 300.1.1.1, 4111 1111 1111 1111 x 4111111111111112 +1 (265) 555-5428. +12 a@b.c@d.e"
    got = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.base_spans(text)]
    assert got == [("email", "a.b+c@x-1.co.uk"), ("email", "a@b.c"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (265) 555-5428")]
    assert pii.base_spans("") == []


def test_contexts_find_unseen_identifiers(spark, docs):
    rng = random.Random(4)
    texts = [f"{prose(8, rng)} contact: {chr(97 + i % 26)}{i}@mail{i % 7}.example.com regards {prose(8, rng)}" for i in range(40)]
    texts += [f"{prose(5, rng)} contact: user{i}-at-mail{i} regards" for i in range(5)]
    plain = [f"{prose(5, rng)} build 20240101{i} done" for i in range(20)]
    out = {r.doc_id: r for r in pii.find_personal_data(documents(spark, texts + plain)).collect()}
    found = [[texts[i][s.start : s.stop] for s in out[i].spans if s.kind in (0, 4)] for i in range(45)]
    assert all(len(f) == 1 for f in found[:40]) and found[40:] == [[f"user{i}-at-mail{i}"] for i in range(5)]
    assert all(not out[45 + i].spans for i in range(20))
    assert pii.find_personal_data(docs).count() == docs.count() and pii.find_personal_data(empty(spark)).count() == 0


# --- 7 -------------------------------------------------------------------------------------------------------------


def test_host_quality(spark, docs, tmp_path):
    junk = documents(spark, ["a b"] * 40 + ["*** ### $$$ a b c d e f g h i j"] * 40, ["bad"] * 40 + ["noisy"] * 40).withColumn("n_words", F.lit("taken")).withColumn("Score", F.lit("taken"))
    d = docs.union(junk.withColumn("doc_id", F.col("doc_id") + 1000)).union(documents(spark, [prose(40)], ["bad"]).withColumn("doc_id", F.lit(2000).cast("long")).withColumn("n_words", F.lit("t")).withColumn("Score", F.lit("t")))
    out = quality_rules.judge_quality(d)
    names = ("doc_id", "n_words_", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = sorted(tuple(r[n] for n in names) for r in out.collect())
    assert got == sorted(run_sql(quality_rules.ORACLE, documents=d.select("doc_id", "text", "source")))
    kept = {g[0]: g[-1] for g in got}
    assert not kept[2000] and not any(kept[1040 + i] for i in range(40)) and kept[6]
    assert quality_rules.judge_quality(empty(spark)).count() == 0


# --- 8 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [35, 4])
def test_substring_dedup(spark, docs, k):
    texts = corpus()
    want = kept_words(texts, k)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs.repartition(3), k=k).collect()}
    for i, w in enumerate(want):
        assert (got[i].kept_text, got[i].n_words_ - got[i].n_removed) == (" ".join(w), len(w)), i
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


# --- 9 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates(spark, docs, k, percent):
    sizes, want = near(corpus(), k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs.repartition(3), k=k, percent=percent).collect()}
    assert got == {i: (sizes[i], want[i]) for i in range(len(sizes))}
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    seen = 0
    for _ in range(3000):
        s = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 120))).astype(np.uint64))
        n, percent = len(s), int(rng.choice([80, 90]))
        apart = int(rng.integers(0, max(1, n // 4) + 1))
        drop = int(rng.integers(0, apart + 1))
        t = np.unique(np.concatenate((rng.permutation(s)[drop:], rng.integers(0, 2**63, apart - drop).astype(np.uint64))))
        both = len(np.intersect1d(s, t))
        if len(t) and 100 * both >= percent * (n + len(t) - both) and ngram_join.set_id(s) != ngram_join.set_id(t):
            seen += 1
            common = np.sort(rng.permutation(np.union1d(s, t))[: int(rng.integers(0, n + 1))])
            for c in (None, common):
                assert len(np.intersect1d(ngram_join.signatures(s, percent, c), ngram_join.signatures(t, percent, c)))
    assert seen > 500


def cloud(rng):
    sets = []
    for _ in range(int(rng.integers(1, 5))):
        base = rng.integers(0, 2**60, int(rng.integers(12, 200))).astype(np.uint64)
        for _ in range(int(rng.integers(1, 40))):
            k = int(rng.integers(0, max(2, len(base) // 7)))
            sets.append(np.unique(np.concatenate((rng.permutation(base)[k:], rng.integers(0, 2**60, int(rng.integers(0, k + 1))).astype(np.uint64)))))
    return sets


def linked_pairs(sets):
    return [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))]


def test_regions_join_exactly(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(20):
        monkeypatch.setattr(ngram_join, "LEAF", int(rng.integers(2, 30)))
        monkeypatch.setattr(ngram_join, "PIVOTS", int(rng.integers(2, 9)))
        sets = cloud(rng)
        links, want = ngram_join.Region(sets).join(), linked_pairs(sets)
        assert {(max(e), min(e)) for e in links} <= set(want)
        assert components(len(sets), links) == components(len(sets), want)


@pytest.mark.parametrize("rounds", [6, 0])
def test_large_regions_are_split_by_spark(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rng = np.random.default_rng(9)
    sets = [*cloud(rng), *cloud(rng)]
    ids = [i.to_bytes(4, "big") for i in range(len(sets))]
    members = spark.createDataFrame([(1, bytearray(i), bytearray(s.tobytes())) for i, s in zip(ids, sets, strict=True)], "root long, sid binary, elements binary")
    links = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in ngram_join.region_links(members, most=20_000).collect()]
    assert components(len(sets), links) == components(len(sets), linked_pairs(sets))


# --- 10 ------------------------------------------------------------------------------------------------------------


def plain_words(text):
    """Runs of letters and non-ASCII, of digits, and of other signs, within what spaces part."""
    import re

    return re.findall(r"[A-Za-z\u0080-\U0010FFFF]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D\u0080-\U0010FFFF]+", text or "")


def bucket_of(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(kernels.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0] % np.uint64(quality_classifier.BUCKETS))


def plain_vectors(texts):
    """{bucket: unit vector}: for each word the index vectors of the two words on either side, added up word by word."""
    places, signs = quality_classifier.index_vectors()
    out = {}
    for t in texts:
        w = [bucket_of(x) for x in plain_words(t)]
        for i, b in enumerate(w):
            v = out.setdefault(b, np.zeros(quality_classifier.DIMS))
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(w):
                    for p, s in zip(places[w[j]], signs[w[j]], strict=True):
                        v[p] += s
    return {b: v / np.linalg.norm(v) if v.any() else v for b, v in out.items()}


def test_word_vectors_and_pooling_by_hand(spark, docs):
    texts = [*corpus(), "a1b2, c!! d", "...", "é1é", "x"]
    rows = documents(spark, texts)
    got = quality_classifier.word_vectors(rows.repartition(3))
    want = plain_vectors(texts)
    assert {int(b) for b in np.flatnonzero(got.any(1))} == {b for b, v in want.items() if v.any()}
    assert all(np.allclose(got[b], v, atol=1e-6) for b, v in want.items())
    features = quality_classifier.pooled(pa.array(texts), got)
    for t, x in zip(texts, features, strict=True):
        v = [want[bucket_of(w)] for w in plain_words(t)]
        n, d = len(v), quality_classifier.DIMS
        assert np.isclose(x[2 * d + 3], np.log1p(n))
        if not n:
            assert not x.any()
            continue
        mean = sum(v) / n
        spread = (sum((u - mean) ** 2 for u in v) / n) ** 0.5
        alike = [sum(a @ b for a, b in zip(v, v[k:], strict=False)) / max(n - k, 1) for k in (1, 2)]
        assert np.allclose(x, [*mean, *spread, *alike, np.linalg.norm(mean), np.log1p(n)], atol=2e-4), t


@pytest.mark.parametrize("n", [20, 20_000])
def test_sums_of_any_size(spark, n):
    """A word that stands beside another often enough leaves the short forms; nothing is cut off."""
    docs = documents(spark, ["p q " * n])
    v = quality_classifier.word_vectors(docs)
    p, q = plain_vectors(["p q " * 8])[bucket_of("p")], v[bucket_of("p")]
    assert np.allclose(np.linalg.norm(q), 1, atol=1e-5) and abs(p @ q) > 0.98


def test_network_learns_all_rows():
    """Rows of one half are of label 1: every slice is learnt from, the first one too."""
    rng = np.random.default_rng(0)
    y = np.arange(600) % 2
    x = rng.normal(0, 1, (600, quality_classifier.FEATURES)) + 3 * y[:, None] * (np.arange(quality_classifier.FEATURES) < 3)
    net = quality_classifier.fit(x, y)
    p = net.score(x)
    assert ((p >= 0.5) == y).mean() > 0.95 and 0.2 <= net.temperature <= 10
    # Calibrated: the mean score of a group is near its share of label 1.
    for low, high in ((0, 0.3), (0.7, 1.01)):
        some = (p >= low) & (p < high)
        assert abs(p[some].mean() - y[some].mean()) < 0.1


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200, 250 / 3, 500 / 3]
    assert mixing.targets([10, 1000], [3, 1]) == [20, 1495]
    assert mixing.targets([0, 0], [3, 1]) == [0, 0] and mixing.targets([], []) == []
    t = mixing.targets([5, 7, 900, 3], [3, 1, 2, 3])
    assert sum(t) == pytest.approx(1.5 * 915) and all(a <= 2 * b + 1e-9 for a, b in zip(t, [5, 7, 900, 3], strict=True))


def test_draws_and_permutations():
    for n in (1, 2, 3, 10, 97, 128, 5000):
        orders = [mixing.permuted(np.arange(n), n, mixing.key_of(4, turn)).tolist() for turn in range(3)]
        assert all(sorted(o) == list(range(n)) for o in orders)
        # No constant step between neighbours, and passes in orders of their own.
        assert n < 97 or (len({(b - a) % n for a, b in zip(orders[0], orders[0][1:], strict=False)}) > n // 3 and orders[0] != orders[1])
    for slots, blocks, shards, ranges in ((7, 5, 1, 1), (5000, 3000, 9, 4), (5000, 2500, 40, 40), (3, 2, 50, 1)):
        parts = [mixing.drawn(17, slots, blocks, shards, ranges, at) for at in range(ranges)]
        slot = np.concatenate([p["slot"] for p in parts])
        shard = np.concatenate([p["shard"] for p in parts])
        block = np.concatenate([p["block"] for p in parts])
        assert slot.tolist() == list(range(slots)) and (np.diff(shard) >= 0).all() and shard.max() < shards
        assert all(sorted(block[a : a + blocks].tolist()) == list(range(blocks)) for a in range(0, slots - blocks + 1, blocks))
        if slots == 5000:
            n = np.bincount(shard, minlength=shards)
            assert ((n - slots / shards) ** 2 / (slots / shards)).sum() < 3 * shards


M64 = (1 << 64) - 1


def mixed_bits(h):
    """splitmix64's finalizer over Python's integers."""
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def plain_key(*parts):
    h = 0
    for x in parts:
        h = mixed_bits((h + x + 0x9E3779B97F4A7C15) & M64)
    return h


def plain_permutation(j, n, key):
    """Six Feistel rounds over an even number of bits, again while the result is not below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    while True:
        left, right = j >> half, j & (1 << half) - 1
        for step in range(6):
            left, right = right, left ^ mixed_bits((right + key + step * 0x9E3779B97F4A7C15) & M64) & (1 << half) - 1
        j = left << half | right
        if j < n:
            return j


def plain_targets(sizes, weights, share):
    """Water filling by bisection: the level at which weight times level, cut at twice the size, sums to the share."""
    total, low, high = min(share * sum(sizes), 2 * sum(sizes)), 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(2 * n, w * level) for n, w in zip(sizes, weights, strict=True)) < total:
            low = level
        else:
            high = level
    return [min(2 * n, w * high) for n, w in zip(sizes, weights, strict=True)]


def plain_mix(docs, block, share=1.5):
    """{doc: words taken, repeats counted}, by lists: documents laid end to end in their source's order, blocks counted off."""
    sizes, order = {}, {}
    for i, (text, source, at) in docs.items():
        n = len((text or "").split())
        sizes[source] = sizes.get(source, 0) + n
        order.setdefault(source, []).append((at, i, n))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = plain_targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], share)
    out = dict.fromkeys(docs, 0)
    for no, (s, g) in enumerate(zip(names, goal, strict=True)):
        line = [i for _, i, n in sorted(order[s], key=lambda x: (x[0], x[2])) for _ in range(n)]
        blocks = -(-len(line) // block)
        passes = int((g + 1e-6) // len(line)) if line else 0
        slots = passes * blocks + (min(blocks, round((g - passes * len(line)) / block)) if line else 0)
        for j in range(slots):
            b = plain_permutation(j % blocks, blocks, plain_key(plain_key(0, no), j // blocks))
            for i in line[b * block : (b + 1) * block]:
                out[i] += 1
    return out, dict(zip(names, goal, strict=True)), sizes


def test_order_lays_documents_end_to_end(spark, docs):
    """Each source's documents tile its words, whatever the order; the order is by hash, and the same for any partitions."""
    at = {}
    for r in mixing.placed(docs, names=("size", "at")).collect():
        at.setdefault(r.source, []).append((r["at"], r["at"] + r["size"]))
    for spans in at.values():
        full = sorted(x for x in spans if x[0] < x[1])
        assert full[0][0] == 0 and all(a[1] == b[0] for a, b in zip(full, full[1:], strict=False))


def test_repeated_rows_are_dealt_on(spark, monkeypatch):
    """One row, a third of all and more: its copies go to many buckets, and still tile the source."""
    monkeypatch.setattr(mixing, "RUN", 8)
    monkeypatch.setattr(mixing, "BUCKETS", 16)
    rows = [(1, "a b c", "s")] * 300 + [(1, "a b c", None)] * 100 + [(i, "x " * (i % 5), "s" if i % 3 else "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__kind", F.lit("taken")).withColumn("pos", F.lit(1))
    out = mixing.placed(docs, names=("size", "at"))
    assert out.columns == [*docs.columns, "size", "at"]
    spans, whole = {}, out.collect()
    assert sorted((r.doc_id, r.text, r.source or "") for r in whole) == sorted((i, t, s or "") for i, t, s in rows)
    for r in whole:
        if r["size"]:
            spans.setdefault(r.source, []).append((r["at"], r["at"] + r["size"]))
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and all(a[1] == b[0] for a, b in zip(x, x[1:], strict=False))
    # Copies are apart from each other: others stand between them.
    mine = [r["at"] for r in whole if r.source == "s" and r.text == "a b c"]
    assert max(mine) - min(mine) > 3 * 300
    again = mixing.placed(docs.repartition(7), names=("size", "at")).collect()
    assert sorted((r.source or "", r["at"], r.doc_id, r["size"]) for r in again if r["size"]) == sorted((r.source or "", r["at"], r.doc_id, r["size"]) for r in whole if r["size"])


def test_mixture_takes_what_the_plain_form_takes(spark, docs):
    at = {r.doc_id: r["at"] for r in mixing.placed(docs, names=("size", "at")).collect()}
    want, goal, sizes = plain_mix({r.doc_id: (r.text, r.source, at[r.doc_id]) for r in docs.collect()}, 16)
    out = mixing.mix_documents(docs, block=16)
    rows = out.collect()
    assert {r.doc_id: sum(u.words * len(u["at"]) for u in r["__uses"] or []) for r in rows} == want
    assert all((r["__source_size"], r["__target"]) == (sizes[r.source], pytest.approx(goal[r.source])) for r in rows)
    # The shards are the same words, block by block: each slot of a source holds one block, in one shard.
    parts = mixing.output_blocks(out, keep=("doc_id", "source")).collect()
    assert sum(p.words for p in parts) == sum(want.values())
    slots = {}
    for p in parts:
        slots.setdefault((p.source, p.slot), set()).add((p.shard, p.block))
    assert all(len(x) == 1 for x in slots.values()) and all(sum(p.words for p in parts if (p.source, p.slot) == k) <= 16 for k in list(slots)[:20])


def test_op10_over_its_tables(spark, docs, tmp_path):
    docs.select(*(x.split()[0] for x in DOCS.split(", "))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in mixing.op10_mix_sources(spark, str(tmp_path)).collect()}
    for r in docs.collect():
        n = len((r.text or "").split())
        assert got[r.doc_id]["size"] == n and 0 <= got[r.doc_id].taken <= 2 * n
    by = {}
    for r in docs.collect():
        by.setdefault(r.source, []).append(got[r.doc_id])
    assert all({x.source_size for x in g} == {sum(x["size"] for x in g)} for g in by.values())
    assert all(abs(sum(x.taken for x in g) - g[0].target) <= 128 for g in by.values())


def test_mixture(spark, docs):
    one = mixing.mix_documents(docs, block=16)
    rows = one.collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        n = len((r.text or "").split())
        uses = r["__uses"] or []
        assert r["__size"] == n and sum(u.words for u in uses) <= n and all(1 <= u.times <= 2 for u in uses)
        s = by.setdefault(r.source, [0, 0, r["__source_size"], r["__target"]])
        s[0] += n
        s[1] += sum(u.words * u.times for u in uses)
    assert all(n == size and abs(taken - target) <= 16 for n, taken, size, target in by.values())
    again = {(r.doc_id, str(r["__uses"])) for r in mixing.mix_documents(docs.repartition(5), block=16).collect()}
    assert again == {(r.doc_id, str(r["__uses"])) for r in rows}
    assert mixing.mix_documents(empty(spark)).count() == 0
