"""b-bit MinHash near-duplicates.

1. One pass over whole texts: the distinct word shingles of a text as 64-bit hashes, their number, an order-free 128-bit
   digest of the set, PERMUTATIONS minima, from which come BANDS band keys and a packed signature that keeps the low
   BITS bits of each minimum.
2. Texts with the same set are one class; its smallest doc_id stands for it from here on.
3. Stars.  In each band bucket the smallest member leads; every text is paired with one leader, the one that it shares
   most buckets with.  STARS further rounds pair it with one random head of another component in its buckets.  So a round
   makes at most one pair a text.  The estimate counts equal b-bit lanes by bit counts and corrects for chance collisions
   of lanes (1 / 2**b); pairs well under the threshold are dropped by it, the others are confirmed on the full sets.
   Confirmed links give components, and buckets with one component are done.
4. The rest, exactly.  What is left are texts in buckets with several components, such as texts around one common passage
   that just aren't similar enough.  A link between two components needs enough shingles that both have; shingles are
   ordered by the number of these texts that have them, rare ones first, and two texts are paired only if they share one
   of the first fifth of their shingles (the smaller one: of the first ninth) so early that the rest can still reach the
   threshold.  Estimate and full sets decide as before.  Pairs within a component can't change it and are never made.

With 44 bands of 6 rows a pair of similarity 0.8 misses all bands with probability (1 - 0.8**6) ** 44 = 2e-6, and texts
that only share a common passage (similarity 0.3) meet in a band with probability 0.0007.

Defined results: a text without words (or null) has an empty set, is linked with nothing and is kept; of rows that share a
doc_id each gets the component of its own text, and texts whose smallest doc_id is the same one are one vertex, as if they
were linked; a null doc_id has no component and isn't kept; an empty table gives an empty result; extra columns are left
alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import common as C
from .graphs import components

BANDS, ROWS, BITS = 44, 6, 4
PERMUTATIONS = BANDS * ROWS
LANES = 256  # minima whose low bits the signature keeps
MARGIN = 0.14  # over five standard deviations of the estimate from 256 lanes
STARS = 2  # rounds with a random head after the leaders' round
ROWS_AT_ONCE = 2_048  # texts that a task hashes at a time
BROADCAST_IDS = 2_000_000  # ids up to this number, 16 MB, are broadcast; more are joined by a shuffle
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct k-word shingles of each text, sorted; a text of 1 to k-1 words has one, the whole."""
    _, _, wh, first = C.words(C.LOWER[data], offs)
    n = np.diff(first)
    doc, at = C.window_starts(first, k)
    h = C.windows(wh, k)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.concatenate([C.windows(wh[first[i] : first[i + 1]], int(n[i])) for i in short])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[keep], h[keep]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set digest (f1, f2), packed signature (s0 to s15) and band keys of each text."""
    lanes = 64 // BITS
    packed = LANES // lanes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.small_batches(batches, "text_value", rows=ROWS_AT_ONCE):
            h, at = shingles(*C.utf8(b.column(1)), k)
            n = np.diff(at)
            full = np.flatnonzero(n > 0)
            digests, bands, low = np.zeros((2, len(n)), np.uint64), np.zeros((len(full), BANDS), np.uint64), np.zeros((packed, len(n)), np.uint64)
            if len(full):
                begin, permuted = at[:-1][full], np.empty_like(h)
                for j, seed in enumerate((0x51, 0xA7)):
                    digests[j, full] = np.add.reduceat(C.mix(h + np.uint64(seed)), begin)
                for j in range(PERMUTATIONS):
                    np.multiply(h, _A[j], out=permuted)
                    np.add(permuted, _B[j], out=permuted)
                    least = C.mix(np.minimum.reduceat(permuted, begin))
                    band, row = divmod(j, ROWS)
                    key = bands[:, band] if row else np.full(len(full), band + 1, np.uint64)
                    bands[:, band] = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
                    if j < LANES:
                        low[j // lanes, full] |= (least & np.uint64((1 << BITS) - 1)) << np.uint64(BITS * (j % lanes))
            starts = pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32))
            cols = [b.column(0), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in (*digests, *low)), pa.ListArray.from_arrays(starts, pa.array(bands.ravel().view(np.int64)))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "f1", "f2", *(f"s{p}" for p in range(packed)), "bands"])

    schema = "doc_id long, n_shingles long, f1 long, f2 long, " + ", ".join(f"s{p} long" for p in range(packed)) + ", bands array<long>"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text_value")), run, schema)


def shingle_sets(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """doc_id and the array of its distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.small_batches(batches, "text_value", rows=ROWS_AT_ONCE):
            h, at = shingles(*C.utf8(b.column(1)), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["doc_id", "shingles"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text_value")), run, "doc_id long, shingles array<long>")


def texts_of(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs whose doc_id is in ids (distinct): ids are broadcast if there are few enough, else both are shuffled."""
    few = ids.count() <= limit
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def estimate(a: str, b: str) -> F.Column:
    """Collision-corrected similarity from packed b-bit signatures in columns a0.. and b0.."""
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    ones -= 1 << 64 if ones >= 1 << 63 else 0
    differ = []
    for p in range(LANES * BITS // 64):
        x = F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))
        any_bit = x
        for s in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, s))
        differ.append(F.bit_count(any_bit.bitwiseAND(F.lit(ones))))
    match = 1 - sum(differ[1:], differ[0]) / LANES
    chance = 1 / (1 << BITS)
    return (match - chance) / (1 - chance)


class _Search:
    def __init__(self, spark: SparkSession, docs: DataFrame, k: int, percent: int, text: str) -> None:
        self.spark, self.k, self.percent, self.text = spark, k, percent, text
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text))
        self.all = C.table(spark, signatures(docs, k, text), "signatures")
        self.sigs = [c for c in self.all.columns if c[0] == "s" and c[1:].isdigit()]
        groups = self.all.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"))
        self.classes = C.table(spark, groups, "classes")  # read again, so that joins can split a hot class's rows
        self.reps = C.table(spark, self.all.join(self.classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "f1", "f2"]), "reps")

    def members(self) -> DataFrame:
        """key, doc_id, lead: the texts of each bucket with two or more, and its smallest."""
        buckets = self.reps.select("doc_id", F.explode("bands").alias("key"))
        lead = buckets.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").select("key", "lead")
        return C.table(self.spark, buckets.join(C.table(self.spark, lead, "lead"), "key"), "members")

    def side(self, name: str) -> DataFrame:
        return self.reps.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n{name}"), *(F.col(c).alias(f"{name}{c[1:]}") for c in self.sigs))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the estimate and then the full sets find similar enough."""
        sizes = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        near = pairs.join(self.side("a"), "a").join(self.side("b"), "b").where(sizes & (estimate("a", "b") >= self.percent / 100 - MARGIN))
        near = C.table(self.spark, near.select("a", "b").distinct(), "near")
        both = near.join(self.sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(self.sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        linked = both.where(100 * common >= self.percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")
        return C.table(self.spark, linked.distinct(), "links")

    def links(self) -> DataFrame:
        live = self.members()
        ids = C.table(self.spark, live.select("doc_id").distinct(), "ids")
        self.sets = C.table(self.spark, shingle_sets(texts_of(self.docs, ids), self.k, self.text), "sets")
        stars = live.where("doc_id <> lead").groupBy("lead", "doc_id").agg(F.count("*").alias("n"))
        links = self.confirmed(_one_each(stars, "lead"))
        for turn in range(STARS):
            live = self.mixed(live, links)
            heads = live.groupBy("key").agg(F.min_by(F.struct("doc_id", "c"), F.xxhash64("doc_id", "key", F.lit(turn))).alias("head"))
            apart = live.join(heads, "key").where(F.col("c") != F.col("head.c"))
            links = links.union(self.confirmed(_one_each(apart.groupBy(F.col("head.doc_id").alias("lead"), "doc_id").agg(F.count("*").alias("n")), "lead")))
        return links.union(self.confirmed(self.rest(self.mixed(live, links))))

    def mixed(self, live: DataFrame, links: DataFrame) -> DataFrame:
        """The members of buckets that hold more than one component, with their component c."""
        comp = C.table(self.spark, components(self.spark, links), "components").select(F.col("v").alias("doc_id"), F.col("component").alias("c"))
        known = live.select("key", "doc_id").join(comp, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
        known = C.table(self.spark, known, "known")
        several = known.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
        return C.table(self.spark, known.join(several, "key", "left_semi"), "live")

    def rest(self, live: DataFrame) -> DataFrame:
        """All pairs (a, b) of texts of ``live`` in different components that may reach the threshold; see the module's 4."""
        of = live.select("doc_id", "c").distinct()
        sets = self.sets.join(of, "doc_id").select("doc_id", F.xxhash64("shingles").alias("v"), "c", F.size("shingles").alias("n"), "shingles")
        sets = C.table(self.spark, sets, "rest")  # with v and n, which beside explode would be worked out for every shingle
        each = sets.select("doc_id", "v", "c", "n", F.explode("shingles").alias("t"))
        shared = each.groupBy("t").agg(F.count("*").alias("df"), F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("t", "df")
        known = C.table(self.spark, each.join(C.table(self.spark, shared, "shared"), "t").select("doc_id", "v", "c", "n", "df", "t"), "shingles")
        ranked = known.groupBy("doc_id", "v", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
        # shingles that no other component has come first: place r of the shared ones is place n - size + r
        least = F.expr(f"int((n * {self.percent} + 99) div 100)")  # shingles in common with a text of the same size or less
        alone = F.col("n") - F.size("ts")
        firsts = ranked.withColumn("alone", alone).withColumn("ts", F.slice("ts", F.lit(1), F.greatest(F.col("n") - least + 1 - alone, F.lit(0))))
        posts = firsts.select("doc_id", "c", "n", "alone", F.posexplode("ts").alias("r", "s")).select("doc_id", "c", "n", (F.col("alone") + F.col("r")).alias("p"), F.col("s.t").alias("t"))
        posts = C.table(self.spark, posts, "posts")  # read again, so that the join can split a hot shingle's rows
        a = posts.where(f"(n - p) * {100 + self.percent} >= {2 * self.percent} * n").select("t", *(F.col(x).alias(f"{x}_a") for x in ("doc_id", "c", "n", "p")))
        b = posts.select("t", *(F.col(x).alias(f"{x}_b") for x in ("doc_id", "c", "n", "p")))
        q = self.percent
        fits = (
            (F.col("c_a") != F.col("c_b")) & (F.struct("n_a", "doc_id_a") < F.struct("n_b", "doc_id_b")) & (100 * F.col("n_a") >= q * F.col("n_b"))
            & ((100 + q) * F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) >= q * (F.col("n_a") + F.col("n_b")))
        )
        return a.join(b, (a["t"] == b["t"]) & fits).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def _one_each(counts: DataFrame, by: str) -> DataFrame:
    """(a, b): for each doc_id b of counts the a that it has most buckets in common with."""
    return counts.groupBy(F.col("doc_id").alias("b")).agg(F.max_by(by, F.struct("n", -F.col(by))).alias("a")).select("a", "b")


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs; see the module."""
    s = _Search(spark, docs, k, percent, text)
    comp = components(spark, s.links())
    members = s.all.select("doc_id", "n_shingles", "f1", "f2").join(s.classes, ["n_shingles", "f1", "f2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = members.join(comp.withColumnsRenamed({"v": "rep"}), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, C.documents(spark, sf_dir), k=2)
