"""WARC archives and URL filters against brute force, and the pipeline."""

import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import queries, urls, warc
from lodestar.llm.common import bloom, bloom_blocks, bloom_hit, materialize


@pytest.fixture
def pages(spark):
    big = "<p>long page é</p>" * 8000
    rows = [
        (5, "http://a.example.net/en/1?x#y", "<p>same</p>"), (3, "https://EXAMPLE.net/fr/", "<p>same</p>"), (9, "ftp://org/fr/x", "<p>same</p>"), (1, None, None), (2, "no scheme", ""), (4, "https://x.example.com/de/7", big),
        (6, "https://x.example.com:80/de/7", big), (None, "http://net", "\r\n\r\nWARC/1.1\r\n\0"), (8, "http://a.net?q://b.org/fr/", "0\r\n\r\n"), (3, "https://EXAMPLE.net/fr/", "<p>same</p>"), (10, "https://casino-x.example.org/#top", "x\ny"), (11, "http://.net/", "z"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({})


def plain_warc(rows):
    least = {}
    for r in rows:
        h = r["html"] or ""
        if r["page_id"] is not None:
            least[h] = min(least.get(h, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        h = (r["html"] or "").encode()
        first = least.get(r["html"] or "")
        kind = "response" if first is None or r["page_id"] == first else "revisit"
        out.append((r["page_id"], len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), kind, None if kind == "response" else first))
    return sorted(map(str, out))


def test_warc_round_trip(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    got = warc.read(spark, path).collect()
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == plain_warc(pages.collect())
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in got if r["record_type"] == "response")


def test_archives_are_gzip(spark, pages, tmp_path):
    import gzip

    warc.write(pages, f"file://{tmp_path}/w")
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    text = b"".join(gzip.decompress(p.read_bytes()) for p in files)
    assert text.count(b"WARC-Segment-Number") > 2 and text.count(b"WARC-Type: continuation") >= 4 and text.startswith(b"WARC/1.1\r\n")


def test_damaged_segments_are_found(spark, pages, tmp_path):
    import zlib

    warc.write(pages.filter("page_id = 4"), f"file://{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").iterdir() if p.name.startswith("part"))
    members = []
    while data:
        z = zlib.decompressobj(31)
        text = z.decompress(data)
        members.append((data[: len(data) - len(z.unused_data)], text))
        data = z.unused_data
    third = next(i for i, (_, t) in enumerate(members) if b"WARC-Segment-Number: 3" in t)
    last = next(i for i, (_, t) in enumerate(members) if b"WARC-Segment-Total-Length" in t)
    pack = lambda t: (z := zlib.compressobj(4, zlib.DEFLATED, 31)).compress(t) + z.flush()
    wrong = re.sub(rb"(WARC-Segment-Total-Length: )\d+", rb"\g<1>7", members[last][1])
    for name, kept in (("gap", members[:third] + members[third + 1 :]), ("total", [*members[:last], (pack(wrong), b""), *members[last + 1 :]])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part").write_bytes(b"".join(m for m, _ in kept))
        with pytest.raises(Exception, match="segments of"):
            warc.read(spark, f"file://{tmp_path}/{name}").collect()


def test_empty_archive(spark, pages, tmp_path):
    warc.write(pages.filter("false"), f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 0


@pytest.mark.parametrize("n", [0, 1, warc.CHUNK, warc.CHUNK + 1, 5 * warc.CHUNK + 7])
def test_chunked_framing(n):
    data = bytes(i % 251 for i in range(n))
    assert warc.unchunked(warc.chunked(data)) == data


def test_broken_chunks():
    with pytest.raises(ValueError):
        warc.unchunked(warc.chunked(b"x" * 50)[:-20])


LISTED = {"casino-x.example.org", "scheme.example/a/b", "org/fr/x", "x.example.com:80/de/7"}


def plain_rule(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)([^#]*)", url or "")
    host, path = ("", "") if not m else (re.sub("[A-Z]", lambda x: x[0].lower(), m[2]), m[3])
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    if best:
        return host, path, *best
    return host, path, None, "block" if m and host + re.sub(r"(\.html|/)$", "", path) in LISTED else "allow"


@pytest.mark.parametrize("blocks", [1, 1 << 20])
def test_url_verdicts(spark, pages, monkeypatch, blocks):
    monkeypatch.setattr(urls, "MOST_BLOCKS", blocks)  # one block: the filter passes nearly all, the join decides
    pages = pages.unionByName(spark.createDataFrame([(50 + i, u, "x") for i, u in enumerate(["http://scheme.example/a/b.html?x", "http://SCHEME.example/a/b/#y", "http://scheme.example/a/b/c", "http://scheme.example/a"])], pages.schema))
    listed = spark.createDataFrame([(u,) for u in [*LISTED, "casino-x.example.org"]], "url string")
    got = urls.verdicts(pages, urls.listing(spark, urls=listed)).collect()
    assert {r["verdict"] for r in got if r["page_id"] in (10, 50, 51)} == {"block"}
    assert len(got) == pages.count()
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_rule(r["url"])


def test_url_lists(spark, pages):
    assert urls.verdicts(pages.filter("false"), urls.listing(spark)).count() == 0
    none = urls.listing(spark).filter("false")
    assert {r["verdict"] for r in urls.verdicts(pages, none).collect()} == {"allow"}


def test_listed_urls_and_the_filter(spark):
    listed = urls.listed_urls(spark, 30)
    assert listed.count() == listed.distinct().count() == 4 * 4 * 3 * 4 * 30 and not listed.filter("url = 'm.casino-win.example.com/de/29'").isEmpty()
    keys = listed.select(F.xxhash64("url").alias("h"))
    blocks = bloom_blocks(keys.count())
    words = bloom(keys, "h", blocks)
    rate = lambda df: df.withColumn("w", words.scalar()).agg(F.avg(F.expr(bloom_hit("h", "w", blocks)).cast("double"))).first()[0]
    assert rate(keys) == 1.0 and rate(spark.range(20000).select(F.xxhash64("id").alias("h"))) < 0.02


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline_stages(spark, docs, no_docs, tmp_path):
    import corpus_pipeline

    clash = docs.withColumn("n_chars", docs["doc_id"])  # columns named like what stages add, nulls in any column, repeated rows
    for rows in (clash.filter("false"), clash):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, now, "")
            if name != "tokens":
                assert after.columns == rows.columns
                now = after = materialize(after, "test-stage")
        taken = after.count()
    assert taken == now.count() > 0
    clash.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert len(got) == taken and all(len(r["ids"]) == r["n_tokens"] for r in got)
