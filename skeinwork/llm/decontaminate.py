"""Benchmark decontamination by templates, in DataFrame functions alone.

Texts are cut into numbers, words and sentence ends.  A template puts typed placeholders for numbers, for units after
numbers and for names (capitalised words within a sentence); other words are lower-cased.  Windows of WINDOW template
words are hashed and joined with the benchmark's.  A document holds an item if it has at least SHARE of the item's
windows and the slots agree: where the windows are aligned, each value that the item has in a slot stands for one value
of the document, for at least half of the values.  This is judged over all alignments together, and where there are
several, over each and over each run of near ones, any of which will do: a document may hold an item more than once.  So re-parameterised questions are found, and chance matches of
templates with unrelated fillers aren't.

Windows of the benchmark with fewer than LITERALS plain words say too little and don't count as templates; an item with such
windows is looked for by the values of all its windows too.  An item's first word is looked for as a word and as a name, as
which it is read within a sentence.  Items shorter than a window are one window of their own length.  Leaked passages cost rows only where a window matches: nothing is paired otherwise.

Defined results: null and empty texts have no windows; an item
without counting windows is found by its values only, and if it has fewer than LITERALS of them not at all; rows that share a
doc_id are one document, whose rows' windows and words lie at the same places; rows without doc_id or item_id are left out; empty tables give an empty result; extra columns
are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW, LITERALS = 8, 4
SHARE = 50  # percent of an item's windows
AS_IS, NAMED, EXACT = 0, 1, 2  # the ways in which an item is looked for
ALL, NEAR = "all", 4  # the alignments of a document and item together; shifts so near may be of one copy
BROADCAST_ROWS = 500_000  # windows of the benchmark, or ids, up to this number are broadcast; more are shuffled
PATTERN = r"[0-9]+(?:[.,:/][0-9]+)*|\p{L}+(?:'\p{L}+)*|[.!?]"
# Units of measure.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent", "miles", "feet", "inches", "pounds", "meters", "metres", "degrees"]


def _typed(raw: str) -> Column:
    """The template word and the value of each token; sentence ends have a null word."""

    def one(x: Column, i: Column) -> Column:
        before = F.get(F.col(raw), i - 1)
        number = lambda c: (c >= "0") & (c < ":")
        initial, second = F.substring(x, 1, 1), F.substring(x, 2, 1)
        name = (i > 0) & initial.between("A", "Z") & second.between("a", "z") & ~before.isin(".", "!", "?")
        unit = (i > 0) & number(before) & F.lower(x).isin(*UNITS)
        word = F.when(x.isin(".", "!", "?"), F.lit(None)).when(number(x), F.lit("<num>")).when(unit, F.lit("<unit>")).when(name, F.lit("<name>")).otherwise(F.lower(x))
        return F.struct(word.alias("t"), x.alias("v"))

    return F.transform(raw, one)


def templates(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id and toks: the template words and values of each text."""
    out = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0)).alias("raw"))
    return out.select("id", _typed("raw").alias("typed")).select("id", F.filter("typed", lambda s: s.t.isNotNull()).alias("toks"))


def _windows(h: str, n: int) -> Column:
    """(key, pos) of each window of n words over the word hashes h."""
    key = lambda i: F.xxhash64(F.lit(n), *(F.get(F.col(h), i + k) for k in range(n)))
    every = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct(key(i).alias("key"), i.alias("pos")))
    return F.when(F.size(h) >= n, every).otherwise(F.array().cast("array<struct<key:bigint,pos:int>>"))


def _hashed(toks: DataFrame) -> DataFrame:
    return toks.select("id", F.transform("toks", lambda s: F.xxhash64(s.t)).alias("h"), F.transform("toks", lambda s: F.xxhash64(F.lower(s.v))).alias("x"))


def ways(bench: DataFrame) -> DataFrame:
    """id, way and toks: each item as it is, with its first word as a name if it could be one, and for its values (EXACT)
    if windows of either have too few plain words."""
    first = F.get("toks", F.lit(0))
    name = F.substring(first.v, 1, 1).between("A", "Z") & F.substring(first.v, 2, 1).between("a", "z") & (first.t == F.lower(first.v))
    named = F.concat(F.array(F.struct(F.lit("<name>").alias("t"), first.v.alias("v"))), F.slice("toks", 2, F.greatest(F.size("toks") - 1, F.lit(0))))
    typed = bench.where(F.size("toks") > 0).select("id", F.lit(AS_IS).alias("way"), "toks")
    typed = typed.union(bench.where(F.size("toks") > 0).where(name).select("id", F.lit(NAMED).alias("way"), named.cast(bench.schema["toks"].dataType)))
    slots = F.transform("toks", lambda s: F.when(s.t.isin("<num>", "<unit>", "<name>"), F.lit(1)).otherwise(F.lit(0)))
    w = F.least(F.size("toks"), F.lit(WINDOW))
    plain = lambda at: F.aggregate(F.slice(slots, at + 1, w), w, lambda a, x: a - x)
    poor = F.exists(F.transform(F.sequence(F.lit(0), F.size("toks") - w), plain), lambda n: n < F.least(w, F.lit(LITERALS)))
    ids = typed.where(poor & (F.size("toks") >= LITERALS)).select("id").distinct()
    return typed.union(bench.join(ids, "id", "left_semi").select("id", F.lit(EXACT).alias("way"), "toks"))


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """item_id, way, key, bpos and total, the number of the item's counting windows in that way, from ``ways``."""
    sized = bench.withColumn("w", F.least(F.size("toks"), F.lit(WINDOW))).where("w > 0")
    plain = lambda a: F.size(F.filter(a, lambda s: ~s.t.isin("<num>", "<unit>", "<name>")))
    spans = sized.select("id", "way", "w", "toks", F.explode(F.sequence(F.lit(0), F.size("toks") - F.col("w"))).alias("bpos"))
    cut = spans.select("id", "way", "w", "bpos", F.slice("toks", F.col("bpos") + 1, F.col("w")).alias("part"))
    cut = cut.where((F.col("way") == EXACT) | (plain("part") >= F.least(F.col("w"), F.lit(LITERALS))))
    cut = cut.withColumn("part", F.transform("part", lambda s: F.struct(F.when(F.col("way") == EXACT, F.lower(s.v)).otherwise(s.t).alias("t"))))
    keys = reduce(lambda c, n: c.when(F.col("w") == n, F.xxhash64(F.lit(n), *(F.xxhash64(F.get(F.transform("part", lambda s: s.t), F.lit(k))) for k in range(n)))), range(2, WINDOW + 1), F.when(F.col("w") == 1, F.xxhash64(F.lit(1), F.xxhash64(F.col("part")[0]["t"]))))
    rows = cut.select(F.col("id").alias("item_id"), "way", "w", keys.alias("key"), "bpos")
    return rows.join(rows.groupBy("item_id", "way").agg(F.count("*").alias("total")), ["item_id", "way"])


def scoped(hits: DataFrame) -> DataFrame:
    """hits with the sets of alignments that they are judged in: all of a document and item, and where there are several,
    each shift alone and each run of shifts that are at most NEAR apart (a copy with words put in or left out)."""
    keys = ["doc_id", "item_id", "way"]
    shift = (F.col("pos") - F.col("bpos")).cast("long")
    shifts = hits.select(*keys, shift.alias("shift")).distinct()
    before = F.lag("shift").over(Window.partitionBy(*keys).orderBy("shift"))
    opens = shifts.withColumn("opens", F.coalesce(F.col("shift") - before > NEAR, F.lit(True)))
    upto = Window.partitionBy(*keys).orderBy("shift").rowsBetween(Window.unboundedPreceding, 0)
    runs = opens.withColumn("run", F.max(F.when(F.col("opens"), F.col("shift"))).over(upto)).withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1")
    several = runs.select(*keys, "shift", F.explode(F.array(F.concat(F.lit("shift "), F.col("shift").cast("string")), F.concat(F.lit("run "), F.col("run").cast("string")))).alias("scope"))
    alone = hits.withColumn("shift", shift).join(several, [*keys, "shift"])
    columns = [*hits.columns, "scope"]
    return hits.withColumn("scope", F.lit(ALL)).select(*columns).unionByName(alone.select(*columns))


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_slots, n_consistent, n_changed for each item that a document holds."""
    bench = C.table(spark, templates(benchmark.dropDuplicates(["item_id"]), "item_id", "text"), "items")
    bench = C.table(spark, ways(bench), "bench")
    wanted = C.table(spark, benchmark_windows(bench), "wanted")
    stats = wanted.agg(F.count("*").alias("n"), F.collect_set(F.struct((F.col("way") == EXACT).alias("exact"), "w")).alias("lengths")).first()
    toks = templates(docs, "doc_id", text)
    marked = lambda exact, n: F.transform(_windows("x" if exact else "h", n), lambda s: F.struct(s.key.alias("key"), s.pos.alias("pos"), F.lit(exact).alias("exact")))
    every = [marked(exact, n) for exact, n in sorted(stats.lengths)] or [marked(False, WINDOW)]
    seen = _hashed(toks).select("id", F.inline(F.concat(*every)))
    small = wanted.select("item_id", "way", "key", "bpos", "total", (F.col("way") == EXACT).alias("exact"))
    hits = seen.join(F.broadcast(small) if stats.n <= BROADCAST_ROWS else small, ["key", "exact"])
    hits = C.table(spark, hits.select(F.col("id").alias("doc_id"), "item_id", "way", "pos", "bpos", "total").distinct(), "hits")
    judged = scoped(hits)
    held = judged.groupBy("doc_id", "item_id", "way", "scope", "total").agg(F.countDistinct("bpos").alias("n_matched")).where(F.col("n_matched") * 100 >= F.col("total") * SHARE)
    held = C.table(spark, held, "held")

    # slots: the document's values beside the item's, at each alignment of a matched window
    ids = C.table(spark, held.select("doc_id").distinct(), "ids")
    few = ids.count() <= BROADCAST_ROWS
    mine = docs.select(F.col("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    value = lambda name: F.inline(F.transform("toks", lambda s, i: F.struct(i.alias(f"{name}at"), s.t.alias(f"{name}t"), F.lower(s.v).alias(f"{name}v"))))
    slot = lambda c: F.col(c).isin("<num>", "<unit>", "<name>")
    theirs = bench.select(F.col("id").alias("item_id"), "way", value("b")).where(slot("bt"))
    ours = templates(mine, "doc_id", "text").select(F.col("id").alias("doc_id"), value("d")).where(slot("dt"))
    aligned = judged.join(held.select("doc_id", "item_id", "way", "scope"), ["doc_id", "item_id", "way", "scope"], "left_semi").select("doc_id", "item_id", "way", "scope", "bpos", (F.col("pos") - F.col("bpos")).alias("shift"))
    covered = aligned.join(theirs, ["item_id", "way"]).where((F.col("bat") >= F.col("bpos")) & (F.col("bat") < F.col("bpos") + WINDOW)).select("doc_id", "item_id", "way", "scope", "bt", "bv", (F.col("bat") + F.col("shift")).alias("dat")).distinct()
    pairs = covered.join(ours, ["doc_id", "dat"]).where("bt = dt")
    per_value = pairs.groupBy("doc_id", "item_id", "way", "scope", "bt", "bv").agg(F.countDistinct("dv").alias("kinds"), F.max(F.expr("int(dv <> bv)")).alias("changed"))
    slots = per_value.groupBy("doc_id", "item_id", "way", "scope").agg(F.count("*").alias("n_slots"), F.sum(F.expr("int(kinds = 1)")).alias("n_consistent"), F.sum("changed").cast("long").alias("n_changed"))
    out = held.join(slots, ["doc_id", "item_id", "way", "scope"], "left").fillna(0, ["n_slots", "n_consistent", "n_changed"]).where("2 * n_consistent >= n_slots")
    # one row an item: as it is before the other ways; all alignments together if they are consistent, else the one with the most windows
    order = F.struct((-F.col("way")).alias("way"), (F.col("scope") == ALL).alias("whole"), "n_matched", "n_consistent", -F.col("n_slots"), -F.col("n_changed"), "total")
    best = out.select("doc_id", "item_id", F.struct(order.alias("order"), "total", "n_matched", "n_slots", "n_consistent", "n_changed").alias("row")).groupBy("doc_id", "item_id").agg(F.max("row").alias("row"))
    return best.select("doc_id", "item_id", F.col("row.total").alias("n_windows"), *(f"row.{c}" for c in ("n_matched", "n_slots", "n_consistent", "n_changed")))


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that hold no item."""
    found = C.table(spark, leaks(spark, docs, benchmark, text).select("doc_id").distinct(), "leaks")
    few = found.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(found) if few else found, "doc_id", "left_anti").select(*docs.columns)


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
