"""Pairs of Bloom filters, once-seen and twice-seen, filled by tasks and merged in slices."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, share, stash, table

SLICE_BITS = 1 << 20
#: Bits for a key, while the bound allows it.
BITS_PER_KEY = 8
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _places(hashes: np.ndarray, bits: int, n: int = 2) -> list[np.ndarray]:
    """One or two bit places for each hash."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    mixed = hashes ^ (hashes >> np.uint64(29))
    return [((mixed * m) >> shift).astype(np.int64) for m in _MULT[:n]]


def _set(bits: np.ndarray, place: np.ndarray) -> None:
    # Places are unique, so bytes are gathered by position in their byte.
    for b in range(8):
        p = place[(place & 7) == b] >> 3
        bits[p] |= np.uint8(1 << b)


def _get(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & np.uint8(1) != 0


def _fill(hashes_of, n_bits, column, n_places):
    schema = pa.schema([("part", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])

    def add(once, twice, pending):
        for place in zip(*(_places(h, n_bits, n_places) for h in pending)):
            found, counts = np.unique(np.concatenate(place), return_counts=True)
            again = (counts > 1) | _get(once, found)
            _set(twice, found[again])
            _set(once, found)

    def run(batches):
        once, twice, pending, size, seen = np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8), [], 0, False
        for b in cut(batches, column):
            for h in hashes_of(b):
                pending.append(h)
                size += len(h)
            seen = True
            if size > 1 << 20:
                add(once, twice, pending)
                pending, size = [], 0
        if pending:
            add(once, twice, pending)
        if not seen:
            return
        step = min(SLICE_BITS, n_bits) // 8
        for i in range(0, n_bits // 8, step):
            a, c = once[i:i + step], twice[i:i + step]
            if a.any():
                yield table(schema, part=[i // step], once=[zlib.compress(a.tobytes(), 1)],
                            twice=[zlib.compress(c.tobytes(), 1) if c.any() else b""])
    return run


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One slice of all tasks, streamed: two bit tables in memory however many tasks there were."""
    schema = pa.schema([("part", pa.int64()), ("twice", pa.binary())])
    once = twice = None
    for b in batches:
        for a, c in zip(b.column("once").to_pylist(), b.column("twice").to_pylist()):
            a = np.frombuffer(zlib.decompress(a), np.uint8)
            if once is None:
                once, twice = np.zeros(len(a), np.uint8), np.zeros(len(a), np.uint8)
            twice |= once & a
            if c:
                twice |= np.frombuffer(zlib.decompress(c), np.uint8)
            once |= a
    yield table(schema, part=[key[0].as_py()], twice=[zlib.compress(twice.tobytes(), 1)])


def count_keys(docs: DataFrame, n_keys) -> int:
    """Sum of a column expression for the number of keys of a row."""
    return docs.agg(F.coalesce(F.sum(n_keys), F.lit(0)).cast("long")).first()[0]


def bits_for(n: int, max_bits: int) -> int:
    """Bits of a filter of so many keys."""
    n_bits = 1 << 13
    while n_bits < BITS_PER_KEY * n and n_bits * 2 <= max_bits:
        n_bits *= 2
    return n_bits


def fill_twice(docs: DataFrame, hashes_of, n_keys, max_bits: int, text: str | None = "text", n_places: int = 2):
    """Broadcast of the twice-seen filter; `n_keys` is a column expression for the number of keys of a row, or their number.

    `hashes_of` gives arrays of the hashes of the rows of a batch, each once for a row.
    The filter has a power of two bits, at most `max_bits`, so what is sent
    to tasks has a fixed bound."""
    spark = docs.sparkSession
    n_bits = bits_for(n_keys if isinstance(n_keys, int) else count_keys(docs, n_keys), max_bits)
    slices = docs.mapInArrow(_fill(hashes_of, n_bits, text, n_places), "part long, once binary, twice binary")
    # Written, so that the shuffle of the slices of all tasks does not stay.
    merged = stash(slices.groupBy("part").applyInArrow(_merge, "part long, twice binary"), "filter")
    bits = np.zeros(n_bits // 8, np.uint8)
    step = min(SLICE_BITS, n_bits) // 8
    for r in merged.toLocalIterator():
        bits[r["part"] * step:(r["part"] + 1) * step] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    release(merged)
    return share(spark, bits)


def suspects(bits: np.ndarray, hashes: np.ndarray, n_places: int = 2) -> np.ndarray:
    """Which hashes may have been seen twice; one that was seen twice always is."""
    if not len(hashes):
        return np.zeros(0, bool)
    hit = [_get(bits, p) for p in _places(hashes, len(bits) * 8, n_places)]
    return hit[0] & hit[1] if n_places == 2 else hit[0]


def _ids_twice(batch):
    # Each id counts as seen twice, so that the filter holds all ids.
    h = np.unique(batch.column("doc_id").to_numpy().view(np.uint64))
    return [h, h]


def fill_ids(ids: DataFrame, max_bits: int = 1 << 26):
    """Broadcast filter of the non-null doc_ids of a table."""
    return fill_twice(ids.select("doc_id").filter("doc_id IS NOT NULL"), _ids_twice, F.lit(1), max_bits, text=None)


def ids_inside(bits: np.ndarray, column) -> np.ndarray:
    """Which doc_ids of a batch may be in the filter; null ids are not."""
    null = np.asarray(column.is_null())
    ids = column.fill_null(0).to_numpy(zero_copy_only=False)
    return suspects(bits, ids.astype(np.int64).view(np.uint64)) & ~null


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is not among `gone`, exactly; rows with a null id stay.

    Only rows that a filter of the ids suspects are shuffled."""
    bits = fill_ids(gone)

    def pick(want):
        def run(batches):
            for b in batches:
                ids = b.column(id_col).cast(pa.int64())
                yield b.take(pa.array(np.flatnonzero(ids_inside(bits.value, ids) == want)))
        return run

    names = gone.select(F.col("doc_id").alias("_gone")).distinct()
    some = docs.mapInArrow(pick(True), docs.schema)
    return docs.mapInArrow(pick(False), docs.schema).unionByName(
        some.join(names, F.col(id_col) == F.col("_gone"), "left_anti"))
