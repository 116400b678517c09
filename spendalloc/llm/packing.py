"""Best-fit packing with several permitted sequence lengths.

Documents longer than the longest permitted length are cut into consecutive
pieces. Pieces are dealt by a hash into groups of about `group_rows`, and each
group is packed in decreasing length: a piece goes to the open bin that it
leaves the least room in; if none has room, a bin is opened whose size costs
least per item of content, given what the remaining pieces could still fill it
with. In the end every bin shrinks to the shortest permitted length that holds
its contents. Nothing is cut off or dropped. Lengths are tokens of a named tokenizer
(`token_lengths`) or words between white space (`word_lengths`).

Null and empty texts are pieces of length 0. Ties go by (doc_id, piece), null
ids last. Rows that repeat an id are pieces of their own. An empty table gives
an empty result; extra columns are ignored."""

from bisect import bisect_left, bisect_right, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, share, stash, table
from .encoders import encoder, load_file

CAPACITIES = (1024, 2048, 4096)


def bin_cost(capacity: int) -> float:
    """Places of a sequence and a fixed cost for each sequence."""
    return capacity + 64.0


def _could_fill(room: int, lengths: list[int], left: dict) -> int:
    """What the remaining pieces, longest first, would put into the room."""
    put, used = 0, {}
    at = bisect_right(lengths, room) - 1
    while at >= 0 and lengths[at] > 0:
        n = lengths[at]
        take = min(left[n] - used.get(n, 0), (room - put) // n)
        if take > 0:
            used[n] = used.get(n, 0) + take
            put += take * n
        at = min(at - 1, bisect_right(lengths, room - put) - 1)
    return put


def pack(lengths: list[int], capacities=CAPACITIES, cost=bin_cost):
    """(bin, offset) of each length, given in decreasing order, and the bins' final capacities and contents."""
    capacities = sorted(capacities)
    left: dict = {}
    for n in lengths:
        left[n] = left.get(n, 0) + 1
    distinct = sorted(left)
    rooms: list[int] = []
    by_room: dict = {}
    size, used, places = [], [], []
    for n in lengths:
        left[n] -= 1
        if not left[n]:
            distinct.pop(bisect_left(distinct, n))
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            _, c = min((cost(c) / max(1, n + _could_fill(c - n, distinct, left)), c) for c in capacities if c >= n)
            b, room = len(size), c
            size.append(c)
            used.append(0)
        places.append((b, used[b]))
        used[b] += n
        room -= n
        if room not in by_room or not by_room[room]:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(b)
    return places, [capacities[bisect_left(capacities, u)] for u in used], used


def _word_counts(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("mark", pa.int64())])
    for b in cut(batches):
        yield table(schema, doc_id=b.column("doc_id"), mark=b.column("mark"),
                    size=[len(t.encode("utf-8", "surrogatepass").split()) for t in b.column("text").to_pylist()])


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (words between white space), mark (hash of the text, to tell rows of one id apart)."""
    d = id_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    return d.mapInArrow(_word_counts, "doc_id long, size long, mark long")


def _token_counts(kind, content, version):
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("mark", pa.int64())])

    def run(batches):
        enc = encoder(kind, content.value, version)
        for b in cut(batches):
            yield table(schema, doc_id=b.column("doc_id"), mark=b.column("mark"),
                        size=[enc.count(t) for t in b.column("text").to_pylist()])
    return run


def token_lengths(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (tokens of the whole text, without special tokens), mark, as in `word_lengths`."""
    kind, content, version = load_file(tokenizer_path)
    d = id_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    return d.mapInArrow(_token_counts(kind, share(docs.sparkSession, content), version),
                        "doc_id long, size long, mark long")


def best_fit_packing(sizes: DataFrame, capacities=CAPACITIES, cost=bin_cost, group_rows: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset, bin_capacity, bin_used for every piece.

    `sizes` has doc_id, size and mark, as `token_lengths` and `word_lengths` give them."""
    longest = max(capacities)
    pieces = sizes.select("doc_id", "mark", F.coalesce("size", F.lit(0)).cast("long").alias("size")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / longest) - 1, F.lit(0))
                                      .cast("long")))).select(
        "doc_id", "mark", "piece", (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest), F.col("size") - F.col("piece") * longest).cast("long").alias("length"))
    pieces = stash(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "mark"], ascending=[False, True, True, True], kind="stable")
        places, capacity, used = pack(pdf["length"].tolist(), capacities, cost)
        b = [p[0] for p in places]
        first = int(pdf["grp"].iloc[0]) << 32
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64"), "piece": pdf["piece"], "start": pdf["start"],
            "length": pdf["length"], "bin_id": [first + x for x in b], "bin_offset": [p[1] for p in places],
            "bin_capacity": [capacity[x] for x in b], "bin_used": [used[x] for x in b]})

    return pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "mark"), F.lit(groups))).groupBy(
        "grp").applyInPandas(run, "doc_id long, piece long, start long, length long, bin_id long, bin_offset long, "
                                  "bin_capacity long, bin_used long")
