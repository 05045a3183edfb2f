"""The pipeline's stages on a small table, and its decisions."""

import corpus_pipeline
import pyarrow.parquet as pq

import compare
from skeinwork.llm import common, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.documents(spark, SF)
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.table(spark, stage(spark, docs, SF), name.replace(" ", "-"))
        now = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert now <= ids
        if name in ("secret scans", "best-fit packing"):
            assert now == ids
        if name != "best-fit packing":
            assert docs.columns == columns
        if name == "benchmark decontamination":
            items = pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()
            assert not [r.doc_id for r in docs.collect() if any(t in r.text for t in items)]
        if name == "secret scans":
            assert docs.where("text rlike '[0-9a-f]{24}'").count() == 0
        ids = now
    # near copies of labelled good documents leave at least one of each group
    assert len(ids) > 100


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and doc_ids, clashing names and an empty table, through every stage."""
    good = [r.text for r in common.documents(spark, SF).where("lang = 'en' and n_chars between 600 and 3000").orderBy("doc_id").limit(6).collect()]
    rows = [(1, good[0]), (1, good[0]), (2, good[1] + " api_key = 0123abcd9876ffff"), (3, None), (4, ""), (None, good[2]), (5, good[3]), (5, "short"), (6, good[4].upper())]
    schema = "doc_id long, text string, n_chars long, lang string, source string, base_found string, kept boolean"
    for some in (rows, []):
        docs = spark.createDataFrame([(i, t, len(t or ""), None, None, "clash", None) for i, t in some], schema)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = common.table(spark, stage(spark, docs, SF), "odd")
            if name != "best-fit packing":
                assert docs.columns == columns
            if name == "secret scans" and some:
                assert {r.doc_id for r in docs.collect()} <= {1, 2, 5, 6} and {r.base_found for r in docs.collect()} == {"clash"}
                assert not docs.where("text like '%0123abcd9876ffff%'").count() and docs.where("text like '%[SECRET]%' and n_chars = length(text)").count() == 1
        assert docs.isEmpty() == (not some)


def test_oracles(spark):
    con = compare.connect(SF)
    for name, sql in queries.ORACLE_SQL.items():
        assert compare.differences(queries.QUERIES[name](spark, SF), sql, con) == ""


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
