"""Searches and codes of vectors against brute force."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from skeinwork.llm import codes, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, v string, own long, error string"


def whole(vec):
    """The integer vector, or None if it takes no part."""
    if vec is None or any(x is None or not math.isfinite(x) for x in vec):
        return None
    out = [math.floor(1024 * x) for x in vec]
    return out if sum(x * x for x in out) < 2**60 else None


def made(seed, n, width):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, rng.gauss(0, 0.3)]) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(5, None, 1), (10, [math.nan] * width, 1), (15, [None] * width, 2), (20, [math.inf] + [0.0] * (width - 1), None), (25, [1e300] * width, 1)]
    rows += [(30, rows[0][1], 1)] * 3 + [(None, rows[3][1], None), (40, rows[40][1], 2), (40, [0.0] * width, 2)]
    rows += [(1000 + i, [0.25] * width, 1) for i in range(40)]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(parts)


def best(rows, k, every):
    kept = [(i, whole(v)) for i, v, _ in rows if whole(v) is not None]
    out = []
    for q, (i, v) in enumerate(kept):
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for at, (j, w) in enumerate(kept) if at != q)[:k]
            out += [(i, r, None if unknown else j, -s) for r, (s, unknown, j) in enumerate(scored, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, slice_rows", [(16_384, 32_768), (16, 7)])
def test_top_equals_brute_force(spark, monkeypatch, block, slice_rows):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = made(1, 120, 9)
    got = sorted(map(tuple, vectors.top(spark, frame(spark, rows), 10, 5, slice_rows).collect()), key=repr)
    assert got == best(rows, 10, 5)


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [3.0], 1), (2, [], 1)]
    assert sorted(map(tuple, vectors.top(spark, frame(spark, rows), 10, 2).collect())) == best(rows, 10, 2)
    assert vectors.top(spark, frame(spark, [(0, [1.0], 1)]), 10, 2).count() == 0
    for none in ([], [(0, None, 1)]):
        assert vectors.top(spark, frame(spark, none), 10, 2).count() == 0
        assert codes.compress(spark, frame(spark, none)).count() == 0


def test_selection_of_ties():
    r = np.random.default_rng(2)
    for _ in range(200):
        scores = r.integers(0, 5, r.integers(1, 40))
        k = int(r.integers(1, 12))
        assert sorted(vectors.select(scores, k)) == sorted(sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:k])


def test_postings_are_sparse_or_whole():
    block = np.zeros((100, 3), np.int64)
    block[:10, 0], block[:, 1] = 2, 3
    (a, _), (b, _), (c, w) = vectors.postings(block)
    assert list(a) == list(range(10)) and b is None and len(c) == len(w) == 0
    assert (vectors.accumulate(np.array([5, 1, 9, 4]), vectors.postings(block), 100) == block @ [5, 1, 9]).all()


def encoded(rows, parts, entries, rounds):
    kept = sorted(((i, whole(v), label) for i, v, label in rows if whole(v) is not None), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    x = np.array([v + [0] * (parts * width - len(v)) for _, v, _ in kept], dtype=object).reshape(len(kept), parts, width)
    books = [[x[i][p].copy() for i in range(min(entries, len(kept)))] for p in range(parts)]
    near = lambda p, piece: min((sum((piece - c) ** 2), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        to = [[near(p, x[i][p])[1] for i in range(len(kept))] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[i][p] for i in range(len(kept)) if to[p][i] == e]
                if mine:
                    books[p][e] = sum(mine) // len(mine)
    found = [[near(p, x[i][p]) for p in range(parts)] for i in range(len(kept))]
    error = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    of_label = {}
    for (_, _, label), e in zip(kept, error):
        of_label[label] = of_label.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), e, of_label[label], digest) for (i, _, label), f, e in zip(kept, found, error)), key=repr)


@pytest.mark.parametrize("entries, labels", [(16, 100_000), (256, 0)])
def test_codes_equal_brute_force(spark, monkeypatch, entries, labels):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", labels)
    rows = made(3, 90, 10)
    got = sorted(map(tuple, codes.compress(spark, frame(spark, rows), 4, entries, 3).collect()), key=repr)
    assert got == encoded(rows, 4, entries, 3)


def test_annuli_are_exact_and_prune(monkeypatch):
    monkeypatch.setattr(codes, "PAIRS", 64)
    r = np.random.default_rng(4)
    entries = r.integers(-400, 400, (256, 4)) * r.integers(0, 6, (256, 1))
    x = r.integers(-2000, 2000, (500, 4))
    x[:50] = entries[:50]  # distance 0, at an annulus of no width
    entries[100:120] = entries[40]  # ties
    book = codes.Annuli(entries)
    index, d = book.nearest(x)
    every = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (d == every.min(1)).all() and (index == every.argmin(1)).all()
    assert book.evaluated < 0.7 * every.size


def test_sliced_batches():
    col = pa.array([[1, 2], [3], [], [4, 5, 6]], pa.list_(pa.int32())).slice(1, 3)
    assert vectors.dense(col).tolist() == [[3, 0, 0], [0, 0, 0], [4, 5, 6]]
