"""Web archives, Merkle manifests and fill-in-the-middle texts: round trips, brute force, nulls, ties, repeats, empties."""

import base64
import gzip
import hashlib
import re
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from epiweave.llm import common, fill_middle, merkle, warc

from ..conftest import SF, rows_of


@pytest.mark.parametrize("module,name", [(warc, "op11_warc"), (merkle, "op12_merkle"), (fill_middle, "op13_fill_middle")])
def test_queries_match_sql(spark, duck, module, name):
    got, want = getattr(module, name)(spark, SF).toPandas(), duck.sql(module.ORACLE).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


# --- archives

LONG = "<p>é</p>" * 200
PAGES = [(1, "http://a.org/x y\n", LONG, 0), (9, "http://b.org/", LONG, 0), (9, "http://b.org/", LONG, 0), (None, None, LONG, 0), (4, "", None, 0), (5, "http://c.org/é", "short", 0), (6, "http://c.org/", "short", 0),
         (-7, "http://d.org/", "\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\n\n\nhttp://e.org 0.0.0.0 1 text/html 5\n\0\0\0" * 40, 0), (2**62 + 1, "http://d.org/", "x" * 3000, 0), (-(2**63), "http://d.org/", "y" * 3000, 0)]
PAGE_SCHEMA = "page_id long, url string, html string, path int"


@pytest.fixture(scope="module", params=[0, 1000])
def archives(spark, request):
    """With the lists of revisits shuffled and broadcast."""
    arcs, warcs = common.shared_dir(spark, "arc"), common.shared_dir(spark, "warc")
    warc.write_arc(spark.createDataFrame(PAGES, PAGE_SCHEMA).repartition(3), arcs, archive_bytes=2000)
    warc.convert(spark, arcs, warcs, archive_bytes=2500, most=request.param)
    return arcs, warcs


def test_archives_round_trip(spark, archives):
    rows = warc.read_warc(spark, archives[1], payload=True).collect()
    assert sorted((r.page_id is None, r.page_id, r.payload_digest) for r in rows if r.page_id != 9) == sorted((p[0] is None, p[0], hashlib.sha1((p[2] or "").encode()).hexdigest()) for p in PAGES if p[0] != 9)
    kept = [r for r in rows if r.payload_digest == hashlib.sha1(LONG.encode()).hexdigest()]
    (whole,) = (r for r in kept if r.record_type == "response")
    assert whole.page_id == 9 and bytes(whole.payload) == LONG.encode() and whole.refers_to is None
    again = [r for r in kept if r.record_type == "revisit"]
    assert sorted(str(r.page_id) for r in again) == ["1", "9", "None"]
    assert all(r.refers_to == 9 and r.refers_to_id == whole.record_id and r.payload is None and r.payload_bytes == len(LONG.encode()) for r in again)
    assert all(r.record_type == "response" and r.refers_to is None for r in rows if r not in kept)
    assert len({r.record_id for r in rows}) == len(PAGES)
    assert {r.uri for r in rows} == {"http://a.org/x%20y%0A", "http://b.org/", "unknown:", "http://c.org/é", "http://c.org/", "http://d.org/"}
    assert {r.warc_date for r in rows} == {"2020-01-01T00:00:00Z"}


def test_archives_are_plain_files(spark, archives):
    """Any gzip reader reads them; both ARC versions occur; records are found by declared lengths in uncompressed files too."""
    versions, n = set(), 0
    for content in (bytes(r.content) for r in warc.read_files(spark, archives[0]).collect()):
        text = gzip.decompress(content)
        assert content.count(b"\x1f\x8b\x08") >= len(list(warc.parse_arc(content)))
        assert list(warc.parse_arc(text)) == list(warc.parse_arc(content)) == list(warc.parse_arc(gzip.compress(text)))
        versions.add(text.split(b"\n")[1].split()[0])
        n += len(list(warc.parse_arc(content))) - 1
    assert versions == {b"1", b"2"} and n == len(PAGES)
    for content in (bytes(r.content) for r in warc.read_files(spark, archives[1]).collect()):
        first, *rest = warc.parse_warc(gzip.decompress(content))
        assert first[0]["warc-type"] == "warcinfo" and b"converted-from: filedesc://" in first[1]
        for headers, block in rest:
            assert headers["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def test_foreign_arc(spark):
    """Old archives: blanks in urls, dns and plain records, several blank lines, short dates; broken ones raise."""
    body = b"1 0 Crawl\nURL IP-address Archive-date Content-type Archive-length\n"
    text = b"filedesc://a.arc 1.2.3.4 19961022 text/plain %d\n" % len(body) + body + b"\n\nhttp://x.org/a b c 1.2.3.4 199610220102 text/html 21\nHTTP/1.0 200 OK\r\n\r\nhi\n\ndns:x.org - 19961022010203 text/dns 3\nabc\n\n"
    (_, _), (web, block), (dns, other) = warc.parse_arc(text)
    assert web["URL"] == "http://x.org/a b c" and block == b"HTTP/1.0 200 OK\r\n\r\nhi" and other == b"abc"
    (headers, kept), = warc.parse_warc(warc.converted(web, block, 5, None))
    assert headers["warc-type"] == "response" and headers["warc-date"] == "1996-10-22T01:02:00Z" and headers["warc-ip-address"] == "1.2.3.4" and kept == block
    (headers, _), = warc.parse_warc(warc.converted(dns, other, 6, None))
    assert headers["warc-type"] == "response" and headers["content-type"] == "text/dns" and "warc-ip-address" not in headers
    (headers, _), = warc.parse_warc(warc.converted({**dns, "URL": "ftp://x.org/", "Content-type": "image/png"}, other, 6, None))
    assert headers["warc-type"] == "resource" and headers["content-type"] == "image/png"
    for broken in (text[:-9], text.replace(b"1 0 Crawl", b"3 0 Crawl"), text[10:], gzip.compress(text)[:-20], text.replace(b" 1.2.3.4 199610220102 text/html 21", b" 21").replace(b"/a b c", b"/a")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.parse_arc(broken))


def test_record_ids_hold_page_ids():
    for page in (None, 0, 1, -1, 2**63 - 1, -(2**63), 123456789):
        for tag in (0, 2**57 - 1, 12345):
            text = warc.record_id(page, tag)
            assert warc.page_of_id(text) == page and re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", text)
    assert len({warc.record_id(p, t) for p in (None, 0, 1) for t in (0, 1)}) == 6


def test_archives_of_nothing(spark):
    arcs, warcs = common.shared_dir(spark, "arc"), common.shared_dir(spark, "warc")
    warc.write_arc(spark.createDataFrame([], PAGE_SCHEMA), arcs)
    warc.convert(spark, arcs, warcs)
    assert warc.read_warc(spark, warcs).count() == 0


# --- manifests


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(leaves, fan):
    """(top, sibling lists by leaf) of digests in order, without blocks."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % fan
            proofs[k] += nodes[run:i] + nodes[i + 1 : run + fan]
            at[k] = i // fan
        nodes = [h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], proofs


@pytest.mark.parametrize("fan,deep", [(2, 1), (2, 3), (3, 2)])
def test_trees(spark, fan, deep):
    """Blocks of any size give the trees of whole levels, over one or several rounds, for groups of all sizes side by side."""
    sizes = (1, 2, 5, 7, 8, 9, 27, 65)
    nodes = [(g, i, h(str(g), str(i))) for g, m in enumerate(sizes) for i in range(m)]
    out = merkle.tree(spark.createDataFrame(nodes, "g long, rank long, node string").withColumn("above", F.col("rank")), fan, deep)
    got = {(r.g, r.above): r for r in out.withColumns({"proof": merkle.proof_digest(F.col("path")), "root": merkle.fold(F.col("node"), F.col("path"))}).collect()}
    assert len(got) == len(nodes)
    for g, _ in enumerate(sizes):
        top, proofs = brute([x[2] for x in nodes if x[0] == g], fan)
        for i, siblings in enumerate(proofs):
            assert (got[g, i].top, got[g, i].root, got[g, i].proof) == (top, top, h(*siblings))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, above int"
ROWS = [(3, "é", "fr", "s", 1, 0), (None, "x", "fr", "s", 1, 0), (2, None, None, "-", None, 0), (2, "", None, None, 0, 0), (2, "", None, None, 0, 0), (5, "long " * 20_000, "", "s", 7, 0), (10, "a", "Z", "1:a", 1, 0), (9, "a", "a", "1:a", 1, 0)]


def test_manifest_of_odd_rows(spark):
    def leaf(r):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))

    out = merkle.manifest(spark.createDataFrame(ROWS, DOCS), also=F.col("n_chars")).withColumn("p", merkle.proof_digest(F.col("proof"))).collect()
    by = {}
    for r in ROWS:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    tops = {g: brute([leaf(r) for r in sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))], 2) for g in langs}
    root, over = brute([tops[g][0] for g in langs], 2)
    want = sorted((leaf(r), tops[g][0], root, h(*tops[g][1][i], *over[k])) for k, g in enumerate(langs) for i, r in enumerate(sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))))
    assert sorted((r.leaf, r.subroot, r.root, r.p) for r in out) == want
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    (one,) = merkle.manifest(spark.createDataFrame(ROWS[:1], DOCS)).collect()
    assert one.leaf == one.subroot == one.root == leaf(ROWS[0]) and one.proof == []


def test_manifest_finds_tampering(spark):
    """A changed field, a moved separator or another row's proof don't lead to the root."""
    rows = merkle.manifest(spark.createDataFrame(ROWS, DOCS), changed=merkle.leaf(source=F.concat("source", F.lit("!"))))
    rows = rows.select("doc_id", "root", merkle.fold(F.col("leaf"), F.col("proof")).alias("own"), merkle.fold(F.col("changed"), F.col("proof")).alias("other")).collect()
    assert all(r.own == r.root for r in rows)
    assert all(r.other != r.root for r in rows if r.doc_id != 2)
    assert sorted(r.other == r.root for r in rows if r.doc_id == 2) == [False, True, True]  # a null source stays null


# --- fill-in-the-middle

TEXTS = [(1, ""), (2, None), (3, "one line"), (4, "a\nb\nc\n"), (5, "\n\n\n"), (6, "é\r\nü " * 500), (7, "holds <M> itself\nx"), (8, "<P\n><S"), (9, "long line " * 30_000 + "\n" + "x\n" * 30_000), (None, "null id\nx\ny"), (3, "one line"), (11, "\0\n퟿\n😀")]


@pytest.mark.parametrize("frame_bytes", [1, 7, 1 << 16])
@pytest.mark.parametrize("rate,spm", [(100, 50), (100, 0), (100, 100), (40, 50)])
def test_fill_in_middle(spark, frame_bytes, rate, spm):
    docs = spark.createDataFrame([(*r, "z") for r in TEXTS if frame_bytes > 1 or r[0] != 9], "doc_id long, text string, frames string")
    stored = fill_middle.store(docs, frame_bytes)
    out = fill_middle.transform(stored, rate=rate, spm=spm)

    rows = fill_middle.texts(out).collect()
    assert len(rows) == docs.count()
    want = []
    for r, (doc_id, text, _) in zip(rows, docs.collect(), strict=True):
        text = text or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in (0, 8, 16, 24))
        a, z = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
        p, m, s = "".join(lines[:a]), "".join(lines[a:z]), "".join(lines[z:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"
        new = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        own = (None, None) if form == "plain" else (len(p), len(m))
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.text, r.restored) == (doc_id, len(lines), form, *own, new, text)
        assert zstandard.ZstdDecompressor().stream_reader(b"".join(r.output), read_across_frames=True).read() == new.encode()
        want.append((r.doc_id, hashlib.sha256(new.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [(r.doc_id, r.output_sha256, r.restored_sha256) for r in fill_middle.with_digests(out).collect()]
    assert got == want


def test_only_cut_frames_are_opened(spark):
    """Frames without a cut pass byte for byte."""
    stored = fill_middle.store(spark.createDataFrame([(1, "".join(f"line {i}\n" for i in range(5000)))], "doc_id long, text string"), 500)
    frames = [bytes(f["data"]) for f in stored.first()["frames"]]
    output = {bytes(f) for f in fill_middle.transform(stored).first()["output"]}
    assert len(frames) > 50 and sum(f not in output for f in frames) <= 2


def test_frames_of_nothing(spark):
    assert fill_middle.with_digests(fill_middle.transform(fill_middle.store(spark.createDataFrame([], "doc_id long, text string")))).count() == 0
