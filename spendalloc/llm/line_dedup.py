"""Line dedup with two Bloom filters.

The first pass marks the hashes of line keys in two bit tables: seen once, seen
twice. Tables of many tasks merge exactly like counters that stop at two: what
two tables both saw once was seen twice. Only keys whose bits are all set in
the second table are suspected repeats; their digests alone shuffle, to be
counted exactly and to choose a first occurrence. The tables' size is bounded
(`max_bits`): when they fill up, more keys are suspected and shuffled, and the
result stays exact.

A key is a line without white space at its ends, A-Z lower-cased. Null and empty
texts are one empty line. Keys shorter than `min_chars` code points are never
repeats. Documents are told apart by id: rows that repeat an id count as one
document and are each returned; rows with a null id count for no key, but lose
lines like others. With keep="first" the first line with the key, by (doc_id,
place), stays. An empty table gives an empty result; extra columns are ignored."""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bloom import fill_twice, suspects
from .common import cut, id_text, stash, table

STRIP = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def line_keys(text: str) -> list[bytes]:
    return [line.strip(STRIP) for line in text.encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _hashes(min_chars):
    """Hashes of the distinct keys of each document, as the filters take them."""
    def of(batch):
        for t in batch.column("text").to_pylist():
            keys = {k for k in line_keys(t) if _long_enough(k, min_chars)}
            yield np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return of


def _suspected(twice, min_chars):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("place", pa.int64())])

    def run(batches):
        for b in cut(batches):
            out_id, out_key, out_place = [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                first = {}
                for n, k in enumerate(line_keys(t)):
                    if k not in first and _long_enough(k, min_chars):
                        first[k] = n
                keys = list(first)
                hit = suspects(twice.value, np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                for j in np.flatnonzero(hit):
                    out_id.append(i)
                    out_key.append(xxhash.xxh3_128_digest(keys[j]))
                    out_place.append(first[keys[j]])
            yield table(schema, doc_id=out_id, key=out_key, place=out_place)
    return run


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, max_bits: int = 1 << 28,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key digest and first place of every line key that is found in `min_docs` documents or more.

    `is_first` marks the document with the smallest id that has the key."""
    if min_docs < 2:
        raise ValueError("a repeat takes two documents")
    d = id_text(docs, id_col, text_col)
    twice = fill_twice(d.filter("doc_id IS NOT NULL"), _hashes(min_chars), F.length("text") - F.length(F.replace(
        "text", F.lit("\n"))) + 1, max_bits)
    found = stash(d.mapInArrow(_suspected(twice, min_chars), "doc_id long, key binary, place long"), "suspects")
    # Distinct pairs first, so that a key that very many documents have is counted in parts.
    pairs = found.filter("doc_id IS NOT NULL").groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    repeats = pairs.groupBy("key").agg(F.count("one").alias("n"), F.min("doc_id").alias("first_id")).filter(
        F.col("n") >= min_docs).select("key", "first_id")
    # Written, so that adaptive execution can split a key that very many documents have.
    repeats = stash(repeats, "repeats")
    return found.join(repeats, "key").select(
        "doc_id", "key", "place", F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(False)).alias("is_first"))


def _rewrite(text: str, gone: list | None, keep: list | None, min_chars: int, keep_first: bool):
    """The text without its repeated lines, the number of lines, and of those dropped."""
    lines = text.split("\n")
    if not gone:
        return text, len(lines), 0
    gone, keep, kept = set(gone), set(keep or ()), []
    for line, k in zip(lines, line_keys(text)):
        h = xxhash.xxh3_128_digest(k)
        if h not in gone or not _long_enough(k, min_chars):
            kept.append(line)
        elif keep_first and h in keep:
            keep.discard(h)
            kept.append(line)
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _rows(min_chars, keep_first):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()),
                        ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in cut(batches):
            rows = [_rewrite(*r, min_chars, keep_first) for r in zip(*(
                b.column(c).to_pylist() for c in ("text", "_llm_gone", "_llm_keep")))]
            texts = [r[0] for r in rows]
            yield table(schema, doc_id=b.column("doc_id"), text=texts, n_lines=[r[1] for r in rows],
                        n_dropped=[r[2] for r in rows],
                        kept_sha256=[hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts])
    return run


def _replace(min_chars, keep_first, text_col):
    def run(batches):
        for b in cut(batches, text_col):
            gone, keep = b.column("_llm_gone").to_pylist(), b.column("_llm_keep").to_pylist()
            rows = [_rewrite(t or "", g, k, min_chars, keep_first)
                    for t, g, k in zip(b.column(text_col).to_pylist(), gone, keep)]
            # A text that lost nothing stays as it was, null included.
            texts = [r[0] if r[2] else t for r, t in zip(rows, b.column(text_col).to_pylist())]
            own = [n for n in b.schema.names if not n.startswith("_llm_")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if n == text_col else b.column(n) for n in own]
                + [pa.array([r[2] for r in rows], pa.int64())], [*own, "_llm_dropped"])
    return run


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none",
               max_bits: int = 1 << 28, id_col: str = "doc_id", text_col: str = "text",
               keep_columns: bool = False) -> DataFrame:
    """doc_id, text without the lost lines, n_lines, n_dropped, kept_sha256 for every row.

    keep: "none" drops all lines of a repeated key, "first" leaves its first one.
    Two rows with one id and the key would both keep it as first. With
    `keep_columns` the rows of `docs` come back with the text replaced, and
    _llm_dropped, the number of lines lost."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    d = id_text(docs, id_col, text_col)
    repeats = repeated_lines(d, min_docs, min_chars, max_bits)
    gone = repeats.groupBy(F.col("doc_id").alias("_llm_id")).agg(
        F.collect_set("key").alias("_llm_gone"), F.collect_set(F.when(F.col("is_first"), F.col("key"))).alias("_llm_keep"))
    if keep_columns:
        joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_llm_id")), "left").drop("_llm_id")
        return joined.mapInArrow(_replace(min_chars, keep == "first", text_col),
                                 StructType([*docs.schema.fields, StructField("_llm_dropped", LongType())]))
    joined = d.join(gone, F.col("doc_id").eqNullSafe(F.col("_llm_id")), "left")
    return joined.select("doc_id", "text", "_llm_gone", "_llm_keep").mapInArrow(
        _rows(min_chars, keep == "first"),
        "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string")
