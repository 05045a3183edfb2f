"""Typed names against known ones: exact by a join, else the most similar, by a similarity join that blocks on letters.

The similarity of two names is 200 * M / (|x| + |y|), where x and y are the names with their words lower-cased and sorted
and M counts the letters of matching blocks.  A letter can match once, and blocks keep their order, so

* M is at most the number of letters that both have, counted as often as both have them (the count filter);
* |x| can't be more than 200 / least - 1 times |y| (the length filter);
* blocks keep their inner pairs of neighbours: of M letters in at most |x| + |y| - 2 M + 1 blocks, x and y share at least
  3 M - |x| - |y| - 1 pairs (the pair filter).

Letters are made distinct by counting them off (a1, e1, e2, ...), put into one order for all names, rare ones first, and two
names that share enough of them share one of the first ones of each (the prefix), on which they are joined.  What passes the
filters is scored; the filters lose nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_sort_ratio_udf
from ..runtime import ship

FREQUENT = " eariotnslcudpmhgbfywkvxzjq"  # letters of English words, the most frequent first; any order is right
SPACE = r"[\s\x1c-\x1f\x85\xa0]+"


def _rank(letter: Column) -> Column:
    """One character that sorts rare letters first; those that aren't listed come before all."""
    listed = F.translate(letter, FREQUENT, "".join(chr(ord("~") - k) for k in range(len(FREQUENT))))
    return F.when(F.lit(FREQUENT).contains(letter), listed).otherwise(F.lit("!"))


def _counted(items: Column) -> Column:
    """The items, each with the number of equal ones up to it: distinct strings, so that sets of them count like bags."""
    return F.transform(items, lambda x, i: F.concat(x, F.lit("#"), F.lpad(F.size(F.filter(F.slice(items, F.lit(1), i + 1), lambda y: y == x)).cast("string"), 4, "0")))


def grams(names: DataFrame, name: str, least: float) -> DataFrame:
    """names with s (its words lower-cased and sorted), n (letters), letters and pairs (counted), and prefix."""
    words = F.filter(F.split(F.lower(name), SPACE), lambda w: w != "")
    shaped = names.withColumn("s", F.array_join(F.array_sort(words), " ")).withColumn("n", F.length("s"))
    shaped = shaped.withColumn("chars", F.when(F.col("n") > 0, F.split("s", "")).otherwise(F.array().cast("array<string>")))
    shaped = shaped.withColumn("letters", _counted(F.col("chars")))
    neighbours = F.zip_with("chars", F.slice("chars", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    shaped = shaped.withColumn("pairs", _counted(F.filter(neighbours, lambda p: p.isNotNull())))
    # later copies of a letter are rarer than first ones: 9999 less the count goes first
    place = lambda g: F.concat(F.lpad((9999 - F.substring_index(g, "#", -1).cast("int")).cast("string"), 4, "0"), _rank(F.substring_index(g, "#", 1)), g)
    shared = F.ceil(F.col("n") * least / (200 - least) - 1e-9)
    ordered = F.transform(F.array_sort(F.transform("letters", place)), lambda p: F.substring(p, 6, 1 << 20))
    prefix = F.slice(ordered, F.lit(1), F.greatest(F.col("n") - shared + 1, F.lit(1)).cast("int"))
    return shaped.withColumn("prefix", F.when(F.col("n") > 0, prefix).otherwise(F.array(F.lit(""))))


def survivors(typed: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(typed, name): the pairs of typed (typed) and known names (name), each distinct, that may reach the score."""
    # explode would put a filter on the prefix, whose letter work would be pushed below the distinct names, to every row
    a = grams(typed, "typed", least).select("typed", F.col("n").alias("m"), F.col("letters").alias("own"), F.col("pairs").alias("own_pairs"), F.explode_outer("prefix").alias("g"))
    b = grams(known, "name", least).select("name", "n", "letters", "pairs", F.explode_outer("prefix").alias("h"))
    total, low = F.col("n") + F.col("m"), least - 1e-6
    long_enough = 200 * F.least("n", "m") >= low * total
    common = lambda x, y: F.size(F.array_intersect(x, y))
    enough = 200 * common("letters", "own") >= low * total
    neighbours = common("pairs", "own_pairs") >= 3 * F.ceil(total * low / 200) - total - 1
    return a.join(b, F.col("g") == F.col("h")).where(long_enough & enough & neighbours).select("typed", "name").distinct()


def resolve(typed: DataFrame, names: DataFrame, least: float = 70) -> DataFrame:
    """(typed, name, score) of each row of typed (typed): the known name (name) that equals it, else the most similar one,
    the last by name of several; name is null under the least score."""
    ship(names.sparkSession)
    known = names.select("name").where("name is not null").distinct()
    wanted = typed.select("typed").distinct()
    exact = wanted.join(known, F.col("typed") == F.col("name"), "left_semi").select("typed", F.col("typed").alias("name"), F.lit(100.0).alias("score"))
    rest = wanted.join(known, F.col("typed") == F.col("name"), "left_anti")
    scored = survivors(rest, known, least).withColumn("score", F.round(token_sort_ratio_udf("typed", "name"), 6))
    best = scored.where(F.col("score") >= least).groupBy("typed").agg(F.max(F.struct("score", "name")).alias("b"))
    found = rest.join(best, "typed", "left").select("typed", F.col("b.name").alias("name"), F.col("b.score").alias("score"))
    return exact.union(found)


def candidates(question: DataFrame) -> DataFrame:
    """(typed): the words and pairs of neighbouring words of questions (text), without a possessive ending."""
    w = question.select(F.filter(F.split(F.replace(F.col("text"), F.lit("'s"), F.lit("")), r"\s+"), lambda x: x != "").alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.slice(pairs, F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))
    return w.select(F.explode(F.concat("w", pairs)).alias("typed")).distinct()


def entities(question: DataFrame, known: DataFrame, least: float = 75) -> DataFrame:
    """(name, path) of the known names (name, path) that a question's words or word pairs come close to."""
    found = resolve(candidates(question), known, least).where("name is not null").select("name").distinct()
    return known.select("name", "path").join(found, "name", "left_semi").distinct()
