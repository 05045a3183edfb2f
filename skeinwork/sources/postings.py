"""Words of texts found, counted and packed into lists, a batch at a time, within the tasks that read them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..operators.search import K1, B

HELD = 3_000_000  # postings that a task packs at a time; a slab with more has some rows for a word
ROWS = 50_000  # of a batch that leaves a task
OTHERS = bytes(set(range(256)) - set(range(97, 123)))  # bytes that are no letters


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def counter(slab: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """slab, place, id, len, words (distinct ones, null: none), counts (of each) of texts (id, number, lower-cased text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, number, texts = batch.columns
            number, n = number.to_numpy(), len(texts)
            words, owner = _split(texts)
            coded = words.dictionary_encode()
            many = max(1, len(coded.dictionary))
            pairs = owner * many + coded.indices.to_numpy()
            pairs, tf = np.unique(pairs.astype(np.int32) if n * many < 2**31 else pairs, return_counts=True)
            owner_of, code = np.divmod(pairs, many)
            sizes = np.bincount(owner_of, minlength=n)
            ends = np.cumsum(sizes)
            joined = pc.binary_join(_lists(ends, coded.dictionary.take(pa.array(code))), " ")
            length = pa.array(np.bincount(owner, minlength=n).astype(np.int32), mask=pc.is_null(texts).to_numpy(zero_copy_only=False))
            cols = [pa.array(number // slab), pa.array((number % slab).astype(np.int16)), ids, length, pc.if_else(pa.array(sizes > 0), joined, pa.scalar(None, pa.string())), _bytes(ends, tf.astype("<i4"))]
            yield pa.RecordBatch.from_arrays(cols, ["slab", "place", "id", "len", "words", "counts"])

    return run


def _split(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words (a to z) of all texts, one after the other, and for each the place of its text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    letter = (data - np.uint8(97)) < 26  # bytes below a wrap around; those of other characters are 128 or more
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    for edge, of in ((at[:-1][at[:-1] < len(data)], first), (at[1:][at[1:] > 0] - 1, last)):  # a word ends with its text
        of[edge] = letter[edge]
    starts = np.flatnonzero(first)
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) - starts + 1, out=ends[1:])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes().translate(None, OTHERS))])
    return words, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, at)))


def _bytes(ends: np.ndarray, values: np.ndarray) -> pa.BinaryArray:
    """The values' bytes, a binary for each list that ends there."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def terms(words: pa.StringArray, counts: pa.BinaryArray) -> pa.ListArray:
    """Texts' words and counts as lists of (term, tf)."""
    each = pc.split_pattern(words, " ")
    tf = np.frombuffer(b"".join(counts.to_pylist()), "<i4")
    return _lists(np.cumsum(_sizes(each)), pa.StructArray.from_arrays([each.flatten(), pa.array(tf, pa.int32())], ["term", "tf"]))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, term, tf of texts (id, words, counts); a text without words has a row with nulls."""
    for batch in batches:
        ids, words, counts = batch.columns
        has = terms(words, counts)
        n, entries = _sizes(has), has.flatten()
        none = np.flatnonzero(n == 0)
        cols = [pa.concat_arrays([entries.field(k), pa.nulls(len(none), entries.field(k).type)]) for k in ("term", "tf")]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate([np.repeat(np.arange(len(n)), n), none]))), *cols], ["id", "term", "tf"])


def packer(avg_len: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """term, slab, n, most, and place, tf, len (of n texts each) from texts (slab, place, len, terms) in the slabs' order."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        place, length, terms = (pa.concat_arrays([b.column(k) for b in held]) for k in (1, 2, 3))
        n, entries = _sizes(terms), terms.flatten()
        coded = entries.field("term").dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.sort((codes.astype(np.int64) << 32) + np.arange(len(codes))) & (2**32 - 1)  # stable, and faster than argsort
        owner = np.repeat(np.arange(len(n)), n)[order]
        tf, of = entries.field("tf").to_numpy()[order], pc.fill_null(length, 0).to_numpy()[owner]
        counts = np.bincount(codes, minlength=len(coded.dictionary))
        ends = np.cumsum(counts)
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * of / avg_len))
        most = np.maximum.reduceat(weight, ends - counts) if len(ends) else weight
        slab = np.full(len(ends), held[0].column(0)[0].as_py(), np.int64)
        cols = [coded.dictionary, pa.array(slab), pa.array(counts, pa.int32()), pa.array(most), _lists(ends, pa.array(place.to_numpy()[owner])), _lists(ends, pa.array(tf)), _lists(ends, pa.array(of))]
        return pa.RecordBatch.from_arrays(cols, ["term", "slab", "n", "most", "place", "tf", "len"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slab, n = [], None, 0
        for batch in batches:
            slabs = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(slabs)) + 1).tolist(), len(slabs)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    if held and (slabs[lo] != slab or n >= HELD):
                        yield pack(held)
                        held, n = [], 0
                    held.append(batch.slice(lo, hi - lo))
                    slab, n = slabs[lo], n + int(_sizes(held[-1].column(3)).sum())
        if held:
            yield pack(held)

    return run


# A posting as stored: six bytes, or ten in a row that holds a count or a length over 65,535.
KINDS = {t.itemsize: t for t in (np.dtype([("place", "<u2"), ("tf", w), ("len", w)]) for w in ("<u2", "<u4"))}


def lists_packer(avg_len: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """packer's rows of texts (slab, place, len, words, counts), with a binary column ``list`` instead of place, tf, len."""
    pack = packer(avg_len)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = (pa.RecordBatch.from_arrays([*b.columns[:3], terms(b.column(3), b.column(4))], ["slab", "place", "len", "terms"]) for b in batches)
        for batch in pack(opened):
            ends = np.cumsum(batch.column("n").to_numpy().astype(np.int64))
            parts = {k: batch.column(k).values.to_numpy() for k in ("place", "tf", "len")}
            kind = KINDS[6 if max(parts["tf"].max(initial=0), parts["len"].max(initial=0)) < 65536 else 10]
            flat = np.empty(len(parts["place"]), kind)
            for k, v in parts.items():
                flat[k] = v
            for begin in range(0, len(ends), ROWS):
                some = batch.slice(begin, ROWS)
                own = ends[begin : begin + ROWS]
                before = own[0] - some.column("n")[0].as_py()
                yield pa.RecordBatch.from_arrays([*some.columns[:4], _bytes(own - before, flat[before : own[-1]])], ["term", "slab", "n", "most", "list"])

    return run


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, slab, place, tf, len of postings (term, slab, n, list)."""
    for batch in batches:
        n = batch.column(2).to_numpy()
        parts = [np.frombuffer(x, KINDS[len(x) // k]) for x, k in zip(batch.column(3).to_pylist(), n.tolist())]
        row = pa.array(np.repeat(np.arange(len(n)), n))
        flat = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in ("place", "tf", "len")}
        cols = [batch.column(0).take(row), batch.column(1).take(row), pa.array(flat["place"].astype(np.int16)), pa.array(flat["tf"].astype(np.int32)), pa.array(flat["len"].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, ["term", "slab", "place", "tf", "len"])


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """postings (bucket, term, slab, n, most, list) with arrays place, tf, len instead of the binary."""
    for batch in batches:
        flat = next(unpacked(iter([pa.RecordBatch.from_arrays([batch.column(k) for k in (1, 2, 3, 5)], ["term", "slab", "n", "list"])])))
        ends = np.cumsum(batch.column(3).to_numpy())
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(_lists(ends, flat.column(k)) for k in ("place", "tf", "len"))], ["bucket", "term", "slab", "n", "most", "place", "tf", "len"])
