"""WARC writing, segment reassembly and chunked framing."""

import base64
import hashlib
import random

import pytest

from skeinwork.llm import common, warc

rng = random.Random(2)
BIG = "".join(rng.choice("abc<>é\n") for _ in range(70_000))
PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e\r\nX: y", BIG), (6, "http://f", BIG + "!"), (7, "http://g", BIG), (None, "http://h", "<p>x</p>"), (None, "http://i", "lone")]


def run(spark, pages, folder):
    manifest = common.table(spark, warc.write(warc.roles(spark, pages, "html"), folder), "m")
    return warc.reassemble(common.table(spark, warc.read(manifest), "r"))


def test_round_trip(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, payload string, sha int")
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run(spark, pages.repartition(3), f"file://{tmp_path}/w").collect())
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert got == sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run(spark, pages.repartition(3), f"file://{tmp_path}/w0").collect())
    first, expected = {}, []
    for i, _, html in sorted(PAGES, key=lambda p: p[0] or 99):
        raw = (html or "").encode()
        ref = first.setdefault(raw, i)
        expected.append(((i or 0), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if ref == i else "revisit", None if ref == i else ref))
    assert got == sorted(expected)
    assert run(spark, pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_headers(spark, tmp_path):
    """Every record has what the format asks for, and no identifier occurs twice."""
    pages = spark.createDataFrame([(1, "http://a", BIG), (2, "http://b", BIG), (3, None, "x")], "page_id long, url string, html string")
    paths = [r.path for r in warc.write(warc.roles(spark, pages, "html"), f"file://{tmp_path}/w").collect()]
    heads = [warc.parse(m)[0] for p in paths for m in warc.members(p)]
    need = {"warc-type", "warc-record-id", "warc-date", "warc-target-uri", "content-length"}
    assert all(need <= set(h) for h in heads) and len({h["warc-record-id"] for h in heads}) == len(heads) > 5
    assert all((h.get("content-type") == warc.HTTP) == (h["warc-type"] != "continuation") for h in heads)
    assert all(len(h["warc-date"]) == 20 and h["warc-date"].endswith("Z") for h in heads)


def test_repeated_page_ids(spark, tmp_path):
    pages = [(1, "http://a", BIG), (1, "http://a", BIG), (1, "http://a", BIG + "?"), (1, "http://a", "short"), (2, "http://b", BIG), (None, "http://c", BIG)]
    got = run(spark, spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/w").collect()
    big = len(BIG.encode())
    assert sorted(((r.page_id or 0), r.payload_bytes, r.record_type, (r.refers_to or 0)) for r in got) == [(0, big, "revisit", 1), (1, 5, "response", 0), (1, big, "response", 0), (1, big, "response", 0), (1, big + 1, "response", 0), (2, big, "revisit", 1)]


def test_revisits_name_records_that_exist(spark, tmp_path):
    rows = [(i % 50, f"http://{i % 3}" if i % 4 else None, f"page {i % 20}") for i in range(300)] + [(0, "http://a", "all alike")] * 5 + [(1, "http://b", "all alike")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    paths = [r.path for r in warc.write(warc.roles(spark, pages, "html"), f"file://{tmp_path}/w").collect()]
    heads = [warc.parse(m)[0] for p in paths for m in warc.members(p)]
    ids = [h["warc-record-id"] for h in heads]
    assert len(heads) == len(rows) and len(set(ids)) == len(ids)
    targets = {h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit"}
    assert targets and targets <= {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}


def test_segments_may_lie_anywhere(spark, tmp_path):
    parts = list(warc.records(9, 0, "u", BIG.encode(), None, 1000))
    assert len(parts) > 50
    rng.shuffle(parts)
    paths = []
    for k in range(3):
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(parts[k::3]))
        paths.append((f"file://{tmp_path}/{k}.warc.gz", 1))
    (row,) = warc.reassemble(warc.read(spark.createDataFrame(paths, "path string, n_records long"))).collect()
    assert (row.page_id, row.payload_bytes, row.payload_digest) == (9, len(BIG.encode()), warc.digest(BIG.encode()))
    (tmp_path / "0.warc.gz").write_bytes(b"".join(parts[0::3][1:]))
    with pytest.raises(Exception, match="segments"):
        warc.reassemble(warc.read(spark.createDataFrame(paths, "path string, n_records long"))).collect()


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_chunked_framing(size):
    for raw in (b"", b"x", b"\r\n0\r\n\r\n" * 9, BIG.encode()[:5000]):
        assert warc.from_chunks(warc.to_chunks(raw, size)) == raw
    assert warc.from_chunks(b"3;note=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.from_chunks(b"5\r\nabc")
