"""Stored postings: a row for each word of a slab, with what the texts themselves hold."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skeinwork.sources import postings, retrieval

TEXTS = [(f"t{i}", " ".join(["the"] * (i % 5 + 1) + ["Of", "a"] * (i % 3) + [f"w{chr(97 + i % 26)}"])) for i in range(100)] + [("none", None), ("empty", ""), ("marks", "?! 7"), ("other", "ÄKa Ka İx the")]


def test_a_row_for_each_word_of_a_slab(spark, tmp_path):
    texts = spark.createDataFrame(TEXTS, "id string, text string").coalesce(1)
    retrieval.write_postings(texts, str(tmp_path), buckets=4, slab=16)
    stored = retrieval.Stored(spark, str(tmp_path))
    rows = stored.table("postings").collect()
    assert len(rows) == len({(r.slab, r.term) for r in rows}) < sum(r.n for r in rows) / 2
    assert all(r.n == len(r.place) == len(r.tf) == len(r.len) for r in rows)
    of = {(r.slab, r.place): r.id for r in stored.table("texts").collect()}
    got = {(of[r.slab, p], r.term): (tf, n) for r in rows for p, tf, n in zip(r.place, r.tf, r.len)}
    words = {r.id: r.ws for r in texts.select("id", retrieval.search.words(F.col("text")).alias("ws")).collect()}
    assert got == {(i, w): (tf, len(ws)) for i, ws in words.items() for w, tf in Counter(ws or []).items()}
    sizes = {r.id: r.len for r in stored.table("texts").collect()}
    assert len(sizes) == len(TEXTS) and sizes["none"] is None and sizes["empty"] == 0


def test_slabs_over_the_bound(monkeypatch):
    texts = [(i // 4, i % 4, 3, [{"term": "a", "tf": 1 + i}, {"term": f"b{i % 3}", "tf": 2}]) for i in range(20)] + [(5, 0, None, []), (5, 1, 0, [])]
    schema = pa.schema({"slab": pa.int64(), "place": pa.int16(), "len": pa.int32(), "terms": pa.list_(pa.struct({"term": pa.string(), "tf": pa.int32()}))})
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, t)) for t in texts[at : at + 7]], schema) for at in range(0, len(texts), 7)]

    def flat():
        rows = [r for b in postings.packer(3.0)(iter(batches)) for r in b.to_pylist()]
        return len(rows), sorted((r["slab"], r["term"], *e) for r in rows for e in zip(r["place"], r["tf"], r["len"]))

    n, every = flat()
    assert every == sorted((s, t["term"], p, t["tf"], length) for s, p, length, ts in texts for t in ts)
    monkeypatch.setattr(postings, "HELD", 1)
    more, again = flat()
    assert more > n and again == every


def test_words_found_in_bytes(spark):
    odd = ["a", "b", "", "ab", "ab cd ", " ab", "é", "aéb", "x\ny z", "日本a語", "z{`a", "!", "Q q", "it's İx \u212aa"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, None, *odd])], "id long, text string").coalesce(1)
    batch = pa.RecordBatch.from_pandas(rows.select("id", F.col("id").alias("number"), F.lower("text").alias("text")).toPandas())
    expected = {r.id: r.ws for r in rows.select("id", retrieval.search.words(F.col("text")).alias("ws")).collect()}
    for part in (batch, batch.slice(3, 9)):
        (got,) = postings.counter(4)(iter([part]))
        lists = postings.terms(got.column("words"), got.column("counts")).to_pylist()
        assert {i: {x["term"]: x["tf"] for x in ts or []} for i, ts in zip(got.column("id").to_pylist(), lists)} == {i: dict(Counter(expected[i] or [])) for i in part.column("id").to_pylist()}
        assert got.column("len").to_pylist() == [None if expected[i] is None else len(expected[i]) for i in part.column("id").to_pylist()]


def test_a_posting_takes_bytes_not_array_items(spark, tmp_path):
    long = " ".join(["much"] * 70_000 + ["few"])
    texts = spark.createDataFrame([(i, long if i == 1500 else f"same w{chr(97 + i % 26)}") for i in range(3000)], "id long, text string").coalesce(1)
    retrieval.write_postings(texts, str(tmp_path), buckets=2)
    stored = retrieval.Stored(spark, str(tmp_path))
    rows = stored.table("postings", packed=True).collect()
    assert [r.n for r in rows if r.term == "same"] == [2999]  # one slab, one row
    assert {len(r.list) / r.n for r in rows} <= {6, 10}
    much = next(r for r in stored.table("postings").collect() if r.term == "much")
    assert (much.place, much.tf, much.len) == ([1500], [70_000], [70_001])


def test_vectors_of_counted_words(spark, tmp_path):
    texts = spark.createDataFrame(TEXTS, "id string, text string").coalesce(2)
    retrieval.write_postings(texts, str(tmp_path), buckets=2, slab=16)
    assert sorted(retrieval.embedded(spark, str(tmp_path)).collect()) == sorted(retrieval.search.embed(texts).collect())


def test_wide_and_narrow_rows_round_trip(monkeypatch):
    monkeypatch.setattr(postings, "ROWS", 3)
    texts = [(i // 9, i % 9, (70_000 if i == 4 else 5), " ".join(f"w{'abcdefgh'[j]}" for j in range(i % 8 + 1)), (np.arange(i % 8 + 1) + (66_000 if i == 20 else 1)).astype("<i4").tobytes()) for i in range(27)] + [(3, 0, None, None, b"")]
    schema = pa.schema({"slab": pa.int64(), "place": pa.int16(), "len": pa.int32(), "words": pa.string(), "counts": pa.binary()})
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, t)) for t in texts[at : at + 5]], schema) for at in range(0, len(texts), 5)]
    lists = [b.select(["term", "slab", "n", "list"]) for b in postings.lists_packer(4.0)(iter(batches))]
    got = sorted(tuple(r.values()) for b in postings.unpacked(iter(lists)) for r in b.to_pylist())
    assert got == sorted((w, s, p, c, n) for s, p, n, ws, cs in texts for w, c in zip((ws or "").split(), np.frombuffer(cs, "<i4").tolist()))
