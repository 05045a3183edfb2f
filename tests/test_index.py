"""An inline project from files to answers, chunks, stored graphs and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from skeinwork.catalogue.code import FILES
from skeinwork.functions import text as T
from skeinwork.operators import chunking as K
from skeinwork.operators import names as N
from skeinwork.operators import search
from skeinwork.plans import ask
from skeinwork.sources import code, index, store
from skeinwork.streaming import activity


@pytest.fixture(scope="module")
def tables(spark):
    return {k: v.cache() for k, v in index.build(spark, spark.createDataFrame(FILES, "path string, content string")).items()}


def test_edges(tables):
    got = {(r.type, r.src, r.dst) for r in tables["edges"].collect()}
    assert {("IMPORTS", "app.py", "util/text.py"), ("IMPORTS", "app.py", "pkg/models.py")} <= got
    assert ("CALLS", "app.py::Service.run", "app.py::Service.step") in got
    assert ("INSTANTIATES", "app.py::go", "app.py::Service") in got
    assert ("CALLS_EXTERNAL", "app.py::go", "os.getcwd") in got
    assert ("INHERITS_FROM", "app.py::Service", "pkg/models.py::Base") in got and ("INHERITS_EXTERNAL", "pkg/models.py::User", "dict") in got
    assert ("CONTAINS", "repo", "app.py") in got and ("IMPORTS_SYMBOL", "app.py", "app.py#os#os") in got
    assert {r.line for r in tables["edges"].where("type = 'INHERITS_FROM' and src = 'app.py::Service'").collect()} == {9}
    assert ("HAS_METHOD", "app.py::Service", "app.py::Service.run") in got and ("DEFINES_FUNCTION", "app.py", "app.py::go") in got


def test_answers(spark, tables):
    assert {r["file"] for r in ask.ask(spark, "What does app.py import", tables)["rows"]} == {"util/text.py", "pkg/models.py"}
    assert {r["parent"] for r in ask.ask(spark, "what does class Service inherit", tables)["rows"]} == {"pkg/models.py::Base"}
    flow = ask.ask(spark, "show the main entry", tables)
    assert flow["plans"][0].template == "entry_call_chain" and flow["rows"][0]["start"] == "app.py::go"
    assert ask.ask(spark, "strip text helper", tables)["plans"] == [ask.Plan("retrieval")]


def test_chunks_cover_and_bound(tables):
    chunks = tables["chunks"].collect()
    assert len({c.id for c in chunks}) == len(chunks)
    go = next(c for c in chunks if c.function_name == "go")
    assert go.text.startswith('@app.route("/go")') and go.line_start == 20
    service = next(c for c in chunks if c.class_name == "Service")
    assert sorted(service.methods) == ["run", "step"] and all(c.line_end - c.line_start < 100 for c in chunks)


@pytest.mark.parametrize("size,overlap", [(100, 5), (10, 2), (3, 0), (2, 1)])
def test_windows_cover_every_line(spark, size, overlap):
    ns = list(range(0, 240, 7))
    got = spark.createDataFrame([(n,) for n in ns], "n int").select("n", K.windows(F.col("n"), size, overlap).alias("w")).collect()
    for n, ws in got:
        pos, expected = 0, []
        while pos < n:
            end = min(pos + size, n)
            expected.append((pos, end))
            if end == n:
                break
            pos = max(pos + 1, end - overlap)
        assert [(w.start, w.end) for w in ws] == expected


def test_tree_and_store(spark, tmp_path):
    for path, content in FILES:
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(content)
    (tmp_path / "src" / "node_modules").mkdir()
    (tmp_path / "src" / "node_modules" / "x.py").write_text("y = 1")
    files = code.read_tree(spark, str(tmp_path / "src"))
    assert {r.path for r in files.collect()} == {p for p, _ in FILES}
    root = f"file://{tmp_path}/graphs"
    assert not store.exists(spark, root, "r")
    store.save(spark, root, "r", {"nodes": files.select("path")})
    assert store.exists(spark, root, "r") and store.load(spark, root, "r", "nodes").count() == len(FILES)
    first = store.load(spark, root, "r", "nodes")
    store.save(spark, root, "r", {"nodes": files.select("path").limit(2)})
    assert first.count() == len(FILES) and store.load(spark, root, "r", "nodes").count() == 2  # a reader that has begun goes on
    for n in (3, 4):
        store.save(spark, root, "r", {"nodes": files.select("path").limit(n)})
    assert store.load(spark, root, "r", "nodes").count() == 4 and len(list((tmp_path / "graphs" / "r").iterdir())) == 3  # two versions and the markers
    assert store.reset(spark, root, "r", {"nodes": files.select("path").limit(1)}) == 4
    assert store.delete(spark, root, "r") == 1 and store.delete(spark, root, "r") == 0 and not store.exists(spark, root, "r")


def test_failover():
    class Broken(ask.Provider):
        def answer(self, question, context, history):
            raise RuntimeError("rate_limit reached")

    both = ask.Failover(Broken(), ask.Provider())
    assert both.answer("q", "context", []) == "context" and both.used_second


def test_questions_find_names_and_files(spark, tables):
    """Names that aren't quite right resolve, files of the graph's rows scope the chunks, and answers have sources."""
    got = ask.ask(spark, "What does aps.py import", tables)
    assert {r["file"] for r in got["rows"]} == {"util/text.py", "pkg/models.py"} and got["plans"] == [ask.Plan("direct_imports", {"filename": "app.py"})]
    assert {c["path"] for c in got["chunks"]} <= {"util/text.py", "pkg/models.py"} and set(got["sources"]) == {"util/text.py", "pkg/models.py"} and got["score"] > 0
    lone = ask.ask(spark, "tell me of helpr please", tables)
    assert lone["plans"] == [ask.Plan("retrieval")] and {c["path"] for c in lone["chunks"]} == {"util/text.py"} and lone["rows"] == lone["chunks"]
    assert ask.ask(spark, "zzz qqq", tables)["sources"]
    assert ask.ask(spark, "zzz qqq", {**tables, "chunks": tables["chunks"].limit(0)})["score"] is None


def test_names_against_brute_force(spark):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    known = sorted({" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(300)})
    typed = sorted({" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(60)} | set(known[:3]) | {""})
    got = {x.typed: (x.name, x.score) for x in N.resolve(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([*((n,) for n in known), (None,)], "name string")).collect()}
    for t in typed:
        best = max((round(T.token_sort_ratio(t, n), 6), n) for n in known)
        assert got[t] == ((t, 100.0) if t in known else (best[1], best[0]) if best[0] >= 70 else (None, None)), t


def test_vectors_of_zeros(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "id int, embedding array<double>")
    query = lambda *v: spark.createDataFrame([(list(v),)], "embedding array<double>")
    assert [(r.id, r.score) for r in search.top_k(vectors, query(2.0, 0.0)).collect()] == [(2, 1.0), (1, 0.0), (3, -1.0)]
    assert {r.score for r in search.top_k(vectors, query(0.0, 0.0)).collect()} == {0.0}
    made = {r.id: r.embedding for r in search.embed(spark.createDataFrame([(1, "a b a"), (2, None), (3, "12 ..")], "id int, text string"), 8).collect()}
    assert sum(map(abs, made[1])) in (1.0, 3.0) and made[2] == made[3] == [0.0] * 8


def test_long_definitions_go_by_numbered_parts(spark):
    body = "class Big:\n" + "".join(f"    x{i} = {i}\n" for i in range(230)) + "\n\ndef one():\n    pass\n"
    chunks = index.build(spark, spark.createDataFrame([("a/big.py", body)], "path string, content string"))["chunks"].orderBy("line_start").collect()
    assert [(c.function_name, c.line_start, c.line_end, c.filename) for c in chunks] == [("Big_part_0", 1, 100, "big.py"), ("Big_part_1", 96, 195, "big.py"), ("Big_part_2", 191, 231, "big.py"), ("one", 234, 235, "big.py")]


def test_token_sort_ratio():
    assert T.token_sort_ratio("b a", "A b") == 100 and T.token_sort_ratio("abc", "xyz") == 0


def test_stream_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame([(k % 3, t0 + datetime.timedelta(minutes=17 * k), "view" if k % 2 else "buy") for k in range(40)], "key long, ts timestamp, kind string")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = activity.last_seen(stream).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, log.groupBy("key").agg(F.max("ts")).collect()))
    q = activity.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 40
    q = activity.idle_alerts(stream.select("key", "ts")).writeStream.outputMode("update").format("memory").queryName("idle").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.key for r in spark.table("idle").collect()} == {0, 1, 2}


def test_question_sets(spark, tables, tmp_path):
    import json

    from skeinwork.plans import evaluate

    rows = [{"question": "What does app.py import", "ground_truth": "text.py and models.py"}, {"question": "Show the leaf nodes", "ground_truth": "none"}] * 2
    (tmp_path / "q.json").write_text(json.dumps(rows))
    questions = evaluate.read_questions(spark, str(tmp_path / "q.json"))
    assert sorted(r.batch for r in questions.collect()) == [0, 0, 0, 1]
    got = evaluate.recall(evaluate.samples(spark, questions, tables)).collect()
    assert {r.question: r.hit for r in got} == {"What does app.py import": 1.0, "Show the leaf nodes": None}
