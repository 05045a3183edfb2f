"""Stored postings and vectors against searches on the texts themselves."""

import random

import pytest
from pyspark.sql import functions as F

from skeinwork.catalogue.code import FILES
from skeinwork.operators import search
from skeinwork.plans import ask
from skeinwork.sources import index, retrieval, store

rng = random.Random(11)
RARE = [f"rare{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
COMMON = ["the", "of", "data", "line", "with", "text"]


def text(i):
    ws = [rng.choice(COMMON) for _ in range(rng.randint(5, 60))]
    return " ".join(ws + [RARE[i // 12 % 60]] * (i % 4) + [rng.choice(RARE)] * (rng.random() < 0.3))


TEXTS = [(i, text(i)) for i in range(900)] + [(900, None), (901, ""), (902, "?!"), (903, "Data DATA rareaa")]
QUESTIONS = ["rareaa of the data", "the", "rareab RAREAC rarebd line", "unheard of words", "nothingknown", "", "the of data line with text rareaz"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def stored(spark, texts, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('retrieval')}"
    retrieval.write_postings(texts, path, buckets=8, slab=40)
    retrieval.write_vectors(search.embed(texts), path)
    return retrieval.Stored(spark, path)


@pytest.mark.parametrize("question", QUESTIONS)
@pytest.mark.parametrize("k", [3, 25])
def test_words_as_on_the_texts(spark, texts, stored, question, k):
    q = spark.createDataFrame([(question,)], "text string")
    assert stored.bm25(q, k).collect() == search.bm25(texts, q, k).collect()


def test_some_lists_are_left_out(spark, stored, monkeypatch):
    q, seen = spark.createDataFrame([("rareaa of the data",)], "text string"), []
    above = retrieval.Stored._above
    monkeypatch.setattr(retrieval.Stored, "_above", lambda self, *a: seen.append((a, out := above(self, *a))) or out)
    stored.bm25(q, 3).collect()
    (rows, *_), kept = seen[0]
    assert kept.count() < rows.count() / 4
    plan = stored.bm25(q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term" in plan and "split(" not in plan  # the lists of the question's words alone; no text is split


def test_words_within_some_texts(spark, stored):
    q, keep = spark.createDataFrame([("rareaa of the data",)], "text string"), spark.range(0, 904, 7)
    every = stored.bm25(q, 1000).collect()
    assert stored.bm25(q, 5, keep).collect() == [r for r in every if r.id % 7 == 0][:5]


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 1), 1.0], "a") for i in range(50)] + [(90, None, "a"), (91, [0.0] * 3, "b"), (92, [0.0] * 3, "b")]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>, path string")
    retrieval.write_vectors(vectors, f"{tmp_path}/some")
    s = retrieval.Stored(spark, f"{tmp_path}/some")
    for wanted in ([1.0, 2.0, 3.0], [0.0, 0.0, 0.0], [-1.0, 0.0, -9.0]):
        q = spark.createDataFrame([(wanted,)], "embedding array<double>")
        for k in (4, 60):
            assert s.top_k(q, k).collect() == search.top_k(vectors, q, k).collect()
        keep = spark.createDataFrame([("b",)], "path string")
        assert [r.id for r in s.top_k(q, 4, keep, "path").collect()] == [91, 92]
    retrieval.write(spark.createDataFrame([], "id long, text string"), f"{tmp_path}/none")
    none = retrieval.Stored(spark, f"{tmp_path}/none")
    assert none.hybrid(spark.createDataFrame([("a b",)], "text string")).count() == 0


@pytest.mark.parametrize("name", ["embeddings", "texts"])
def test_vectors_as_without_cells(spark, stored, texts, tmp_path, name):
    if name == "texts":
        vectors, s = search.embed(texts), stored
    else:
        vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
        retrieval.write_vectors(vectors, f"{tmp_path}/v")
        s = retrieval.Stored(spark, f"{tmp_path}/v")
    vectors = vectors.cache()
    hits = n = 0
    for i in range(0, 500, 100):
        q = vectors.where(F.col("id") == i)
        exact = search.top_k(vectors, q, 10).collect()
        assert s.top_k(q, 10).collect() == exact
        near = s.top_k(q, 10, exact=False)
        hits, n = hits + len({r.id for r in exact} & {r.id for r in near.collect()}), n + 10
    assert hits >= 0.9 * n
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    cells = s.table("vectors").select("cell").distinct().count()
    assert near.count() and cells > retrieval.PROBED


def test_ask_with_stored_tables(spark, tmp_path):
    built = index.build(spark, spark.createDataFrame(FILES, "path string, content string"))
    root = f"file://{tmp_path}"
    index.save(spark, root, "r", {k: built[k] for k in ("nodes", "edges", "chunks")})
    tables, stored = index.load(spark, root, "r")
    asked = ask.ask(spark, "strip text helper", tables, stored=stored)
    assert asked["plans"] == [ask.Plan("retrieval")] and asked["chunks"]
    assert asked["answer"].startswith("[Code Chunks]\n\n[util/text.py | module_level.") and "lines 1-2 | score 0.03" in asked["answer"]
    fresh = ask.ask(spark, "strip text helper", tables)["chunks"]  # its words are as rare as they are in the named files
    assert {c["id"] for c in asked["chunks"]} == {c["id"] for c in fresh} and {c["path"] for c in fresh} == {"util/text.py"}
    q = spark.createDataFrame([("class with a step",)], "text string")
    assert stored.hybrid(q, 3).collect() == search.hybrid(tables["chunks"].select("id", "text"), q, 3).collect()


class Words(ask.Provider):
    def answer(self, question, context, history):
        return context


def test_results_are_kept_with_their_version(spark, tmp_path):
    built = index.build(spark, spark.createDataFrame(FILES, "path string, content string"))
    root = f"file://{tmp_path}"
    index.save(spark, root, "r", {k: built[k] for k in ("nodes", "edges", "chunks")})
    tables, stored = index.load(spark, root, "r")
    kept = store.Results(spark, root, "r")
    question = "What does app.py import"
    first = ask.ask(spark, question, tables, Words(), stored=stored, results=kept)
    assert first["answer"].startswith("[Graph Relationships]\n\nRecord 1:\n  file: ") and "\n\nRecord 2:\n  file: " in first["answer"] and "\n\n[Code Chunks]\n" in first["answer"]
    without = {**tables, "edges": tables["edges"].limit(0)}
    again = ask.ask(spark, question, without, stored=stored, results=kept)  # is read, not made
    assert again["rows"] == first["rows"] and len(first["rows"]) == 2
    index.save(spark, root, "r", {"nodes": tables["nodes"], "edges": tables["edges"].where("dst <> 'util/text.py'"), "chunks": tables["chunks"]})
    tables, stored = index.load(spark, root, "r")
    new = ask.ask(spark, question, tables, stored=stored, results=store.Results(spark, root, "r"))
    assert [r["file"] for r in new["rows"]] == ["pkg/models.py"]


def test_scores_are_used_again(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0.1), (2, [0.0, 1.0], 0.9), (3, [1.0, 1.0], 0.5)], "id long, embedding array<double>, score double")
    q = spark.createDataFrame([([1.0, 0.0],)], "embedding array<double>")
    ranked = lambda df: [r.id for r in search.rerank(df, q, 2).orderBy("rank").collect()]
    assert ranked(vectors) == [2, 3] and ranked(vectors.drop("score")) == [1, 3]
    assert ranked(vectors.withColumn("score", F.when(F.col("id") > 1, F.col("score")))) == [1, 3]
