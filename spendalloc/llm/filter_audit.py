"""How filters overlap, in every order in which they could run, from sorted posting lists.

Rows get numbers; a filter's posting lists hold, for each part and each range of
row numbers, the sorted numbers of the rows that fail it. Unions of filters that
ran before and differences with the next filter's list are merged range by range,
galloping: a block of the shorter list finds its window in the longer one by
doubling steps, and only that window is searched. Sizes are summed over ranges,
tasks and, weighted, over orders.

Every row of the table is a document: rows that repeat an id count each, rows
with a null id count and are never a later copy. A null text is empty, a null part
the empty string. Labels count where any row of `labels` with the document's id
has a 1. An empty table gives an empty result. Other columns are ignored."""

import hashlib
import re
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, stash, table

#: Row numbers that share a posting list; also the bound of a list.
RANGE_BITS = 15
#: A key with more than one in so many rows is hot; there are at most so many.
HOT = 1000
_UPPER = bytes(range(65, 91))
_BLOCK = 512


def few_words(text: str, raw: bytes, words: list) -> bool:
    return len(words) < 200


def few_distinct(text: str, raw: bytes, words: list) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def many_capitals(text: str, raw: bytes, words: list) -> bool:
    return 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 3 * len(text)


def has_symbols(text: str, raw: bytes, words: list, found=re.compile(r"[#$%&*|]").search) -> bool:
    return found(text) is not None


#: Filters over one text (the text, its bytes, its words); a filter named None fails copies of an earlier id's text.
FILTERS = {"A": few_words, "B": few_distinct, "C": many_capitals, "D": has_symbols, "E": None}


def _failures(filters):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()),
                        ("fails", pa.list_(pa.string()))])

    def run(batches):
        for b in cut(batches):
            digests, fails = [], []
            for text in b.column("text").to_pylist():
                raw = text.encode()
                words = raw.split()
                digests.append(hashlib.sha256(raw).digest())
                fails.append([name for name, fail in filters.items() if fail and fail(text, raw, words)])
            yield table(schema, row=b.column("row"), doc_id=b.column("doc_id"), part=b.column("part"), digest=digests,
                        fails=fails)
    return run


def _copies(rows: DataFrame) -> DataFrame:
    """part, row of the rows whose text an earlier id has."""
    total = rows.count()
    firsts = stash(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter(
        "n > 1"), "firsts")
    # At most HOT digests can have so many rows; they are sent to all tasks, so that no task gets all their rows.
    hot = F.broadcast(firsts.filter(F.col("n") * HOT >= total).select("digest", "first"))
    rest = firsts.filter(F.col("n") * HOT < total).select("digest", "first")
    keyed = rows.select("part", "row", "doc_id", "digest")
    pairs = keyed.join(hot, "digest").unionByName(keyed.join(hot, "digest", "left_anti").join(rest, "digest"))
    return pairs.filter("first < doc_id").select("part", "row")


def _labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """part, row of the rows whose id has a 1 in a column of the labels."""
    ids = labels.filter(F.col(column) == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return rows.select("part", "row", "doc_id").join(ids, "doc_id", "left_semi").select("part", "row")


def posting_lists(rows: DataFrame, labels: DataFrame, filters=FILTERS, label_columns=("quality", "toxic")) -> DataFrame:
    """part, range and one sorted array of row numbers for each filter and label column."""
    entries = rows.select("part", "row", F.explode("fails").alias("list"))
    for name, fail in filters.items():
        if fail is None:
            entries = entries.unionByName(_copies(rows).withColumn("list", F.lit(name)))
    for column in label_columns:
        entries = entries.unionByName(_labelled(rows, labels, column).withColumn("list", F.lit(f"label {column}")))
    names = [*filters, *(f"label {c}" for c in label_columns)]
    return entries.groupBy("part", F.shiftright("row", RANGE_BITS).alias("range")).agg(*(
        F.sort_array(F.collect_list(F.when(F.col("list") == name, F.col("row")))).alias(name) for name in names))


def inside(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which entries of a sorted list are in another one, by galloping."""
    out, at = np.zeros(len(short), bool), 0
    for i in range(0, len(short), _BLOCK):
        block = short[i:i + _BLOCK]
        low, step = at, 1
        while low + step < len(long) and long[low + step] < block[0]:
            low, step = low + step, step * 2
        high, step = low, 1
        while high < len(long) and long[high] <= block[-1]:
            high, step = high + step, step * 2
        window = long[low:high]
        if len(window):
            place = np.searchsorted(window, block)
            place[place == len(window)] = 0
            out[i:i + _BLOCK] = window[place] == block
        at = low
    return out


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[~inside(a, b)] if len(a) and len(b) else a


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two sorted lists; the shorter one's new entries go to their places in the longer one."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    new = difference(short, long)
    return np.insert(long, np.searchsorted(long, new), new) if len(new) else long


def _sizes(names, label_names):
    """(part, set of filters before, filter): sizes of union, filter, difference, and labelled rows in the difference."""
    schema = pa.schema([("part", pa.string()), ("before", pa.int32()), ("filter", pa.int32()),
                        ("sizes", pa.list_(pa.int64()))])
    cases = [(s, f) for s in range(1 << len(names)) for f in range(len(names)) if not s >> f & 1]

    def flush(sums):
        for part, found in sums.items():
            yield table(schema, part=[part] * len(cases), before=[s for s, _ in cases], filter=[f for _, f in cases],
                        sizes=found.tolist())

    def run(batches):
        sums = {}
        for b in cut(batches, None, rows=16):
            for r in b.to_pylist():
                lists = [np.array(r[n], np.int64) for n in names]
                labels = [np.array(r[n], np.int64) for n in label_names]
                before = [np.zeros(0, np.int64)]
                for s in range(1, 1 << len(names)):
                    top = s.bit_length() - 1
                    before.append(union(before[s ^ 1 << top], lists[top]))
                found = np.zeros((len(cases), 3 + len(labels)), np.int64)
                for i, (s, f) in enumerate(cases):
                    gone = difference(lists[f], before[s])
                    found[i] = [len(before[s]), len(lists[f]), len(gone),
                                *(int(inside(label, gone).sum()) for label in labels)]
                sums[r["part"]] = sums.get(r["part"], 0) + found
            if len(sums) > 1000:
                yield from flush(sums)
                sums = {}
        yield from flush(sums)
    return run


def filter_audit(docs: DataFrame, labels: DataFrame, filters=FILTERS, part_col: str = "lang", id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The number of orders is the factorial of the number of filters, so at most six are taken."""
    names = list(filters)
    if len(names) > 6 or any(len(n) != 1 for n in names):
        raise ValueError("at most six filters, each named by a letter")
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stash(numbered.mapInArrow(
        _failures(filters), "row long, doc_id long, part string, digest binary, fails array<string>"), "failures")
    lists = stash(posting_lists(rows, labels, filters), "postings")
    label_names = ["label quality", "label toxic"]
    parts = stash(rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "parts")
    sizes = lists.mapInArrow(_sizes(names, label_names), "part string, before int, filter int, sizes array<long>")
    sizes = stash(sizes.groupBy("part", "before", "filter").agg(*(
        F.sum(F.col("sizes")[i]).alias(n) for i, n in enumerate(("gone", "fails", "removed", "good_lost", "toxic_lost")))),
        "sizes")
    release(rows)
    # The same few numbers for all parts: every order, its steps, and how many orders share a step's past.
    plan = ";".join(f"{''.join(order)},{i + 1},{sum(1 << names.index(n) for n in order[:i])},{names.index(order[i])}"
                    for order in permutations(names) for i in range(len(order)))
    n, every = len(names), (1 << len(names)) - 1
    weight = F.element_at(F.array(*(F.lit(factorial(i) * factorial(n - 1 - i)) for i in range(n))),
                          F.bit_count("before") + 1)
    of_filter = sizes.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == F.lit(every) - F.expr("shiftleft(1, filter)"),
                     F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    fields = "filter_order string, step int, before int, filter int"
    full = parts.select("part", "rows", F.explode(F.split(F.lit(plan), ";")).alias("p")).select(
        "part", "rows", F.inline(F.array(F.from_csv("p", F.lit(fields)))))
    return full.join(sizes, ["part", "before", "filter"], "left").join(of_filter, ["part", "filter"], "left").select(
        "part", "filter_order", "step",
        (F.col("rows") - F.coalesce("gone", F.lit(0)) - F.coalesce("removed", F.lit(0))).alias("kept"),
        zero("removed"), F.coalesce(F.col("fails") - F.col("removed"), F.lit(0)).alias("redundant"),
        zero("unique_fails"), zero("good_lost"), zero("toxic_lost"), zero("shapley"))
