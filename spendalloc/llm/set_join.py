"""Set similarity join over word shingles that uses relations between sets.

Documents become sets of hashed shingles; equal sets are one node. A global
order of shingles (those that a Bloom filter over all documents has seen once,
then by estimated frequency, then by hash) gives each set a prefix in which two
similar sets must share a shingle; what only one document has moves the shared
ones back, so that sizes and places rule out most copies that differ too much. It is counted, not written. Only shingles
that a twice-seen Bloom filter suspects are in two prefixes become postings. Where there are more shingles than the
filter has bits, it is given as large a part of them as it can tell single ones in.

1. Each set is compared with one pivot, the one it shares most postings with.
   The exact overlaps are the pivot's answers. Whole sets are compared only where the overlap of the
   prefixes allows a link even if all that stands behind the prefix of one of them is shared.
2. Components are all that is asked for, so pairs inside one need no comparison.
   In a few turns, sets of lists that hold several components are compared with
   some sets of other components, which joins most groups of near copies.
3. Index lists that still hold several components are cut into blocks by
   component, size and position; whole block pairs are skipped by their bounds.
4. A remaining pair with a common pivot is settled from the two overlaps with
   the pivot where their bounds allow (a set's answers from a similar set's
   answers); only what is left is compared set against set.

The result is exact up to collisions of 64-bit hashes. Words are runs of other
characters than white space, A-Z lower-cased. Null texts and texts without words
have the empty set and stay alone; with fewer words than a shingle takes, the
whole sequence is one. Repeated rows each get a row. An empty table gives an
empty result; extra columns are ignored."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import bits_for, count_keys, fill_ids, fill_twice, ids_inside, suspects
from .common import cut, id_text, release, share, stash, table
from .components import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_K = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 64
_MEET = 8


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = (out + h[i:len(h) - width + 1 + i]) * _K
        out ^= out >> np.uint64(31)
    return np.unique(out)


def _frequent(width, least):
    """Shingles that a task saw in several documents, with their counts."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def flush(sets):
        h, n = np.unique(np.concatenate(sets), return_counts=True)
        often = n >= least
        return table(schema, h=h[often].view(np.int64), n=n[often])

    def run(batches):
        sets, size = [], 0
        for b in cut(batches):
            for t in b.column("text").to_pylist():
                sets.append(shingle_set(t, width))
                size += len(sets[-1])
            if size > 1 << 21:
                yield flush(sets)
                sets, size = [], 0
        if sets:
            yield flush(sets)
    return run


def _chosen(s: np.ndarray, part: float) -> np.ndarray:
    """Which hashes belong to a part of all hashes."""
    return (s * _K >> np.uint64(32)) < np.uint64(part * (1 << 32))


def _shingles(width, part=1.0):
    def of(batch):
        for t in batch.column("text").to_pylist():
            s = shingle_set(t, width)
            yield s if part == 1 else s[_chosen(s, part)]
    return of


def _sketch(width, percent, common, repeated, part=1.0, n_places=2):
    """Number, size and prefix of each set; of the prefix, shingles that no other document has are only counted (`skip`)."""
    schema = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("skip", pa.int64()),
                        ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        known, often = common.value
        for b in cut(batches):
            sids, sizes, skips, prefixes = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, width)
                n = len(s)
                sids.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                sizes.append(n)
                # What no other document has comes first: it costs a place of the prefix and has no postings.
                single = ~suspects(repeated.value, s, n_places)
                if part < 1:
                    single &= _chosen(s, part)
                size = n - (percent * n + 99) // 100 + 1 if n else 0
                skips.append(min(int(single.sum()), size))
                s = s[~single] if skips[-1] < size else s[:0]
                at = np.searchsorted(known, s)
                at[at == len(known)] = 0
                rank = np.where(known[at] == s, often[at], 0) if len(known) else np.zeros(len(s))
                order = np.lexsort((s, rank))
                prefixes.append(s[order][:size - skips[-1]].view(np.int64))
            yield table(schema, doc_id=b.column("doc_id"), sid=sids, n=sizes, skip=skips, prefix=prefixes)
    return run


def _prefix_hashes(batch):
    return [np.array(p, np.int64).view(np.uint64) for p in batch.column("prefix").to_pylist()]


def _postings(twice):
    schema = pa.schema([("h", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])

    def run(batches):
        for b in cut(batches, None):
            hs, sids, sizes, places = [], [], [], []
            for sid, n, skip, p in zip(*(b.column(c).to_pylist() for c in ("sid", "n", "skip", "prefix"))):
                p = np.array(p, np.int64)
                hit = np.flatnonzero(suspects(twice.value, p.view(np.uint64)))
                hs.append(p[hit])
                places.append(skip + hit)
                sids.append(np.full(len(hit), sid))
                sizes.append(np.full(len(hit), n))
            yield table(schema, h=np.concatenate(hs), sid=np.concatenate(sids), n=np.concatenate(sizes),
                        pos=np.concatenate(places))
    return run


def _full_sets(width, ids):
    """Sets of the documents that the filter of ids lets through, and of those without an id."""
    schema = pa.schema([("sid", pa.int64()), ("owner", pa.int64()), ("items", pa.binary())])

    def run(batches):
        for b in cut(batches):
            wanted = ids_inside(ids.value, b.column("doc_id")) | np.asarray(b.column("doc_id").is_null())
            at = pa.array(np.flatnonzero(wanted))
            sets = [shingle_set(t, width) for t in b.column("text").take(at).to_pylist()]
            yield table(schema, owner=b.column("doc_id").take(at), sid=[xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets],
                        items=[s.tobytes() for s in sets])
    return run


def _overlaps(batches):
    """Rows sorted by (pivot, salt, is_member): a pivot's set comes just before its members' sets."""
    schema = pa.schema([("pivot", pa.int64()), ("sid", pa.int64()), ("shared", pa.int64())])
    pivot = None
    for b in batches:
        out = []
        for p, sid, member, items in zip(*(b.column(c).to_pylist() for c in ("pivot", "sid", "is_member", "items"))):
            items = np.frombuffer(items, np.uint64)
            if not member:
                pivot = items
            else:
                at = np.searchsorted(pivot, items)
                at[at == len(pivot)] = 0
                out.append((p, sid, int((pivot[at] == items).sum())))
        if out:
            yield table(schema, **dict(zip(("pivot", "sid", "shared"), map(list, zip(*out)))))


def _compare(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, per_task: int = 256) -> DataFrame:
    """(pivot, sid, shared): exact overlaps. A pivot with many members is repeated, and they are spread.

    `nodes` names the document whose set stands for a node."""
    k = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("long").alias("k"))
    k = stash(k, "fanout")
    rows = pairs.join(k, "pivot").select(
        "pivot", F.pmod(F.xxhash64("sid"), F.col("k")).alias("salt"), "sid", F.lit(True).alias("is_member")).unionByName(
        k.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("salt"),
                 F.col("pivot").alias("sid"), F.lit(False).alias("is_member")))
    named = rows.join(nodes.select("sid", F.col("doc_id").alias("_doc")), "sid")
    s = sets.withColumnRenamed("sid", "_sid")
    full = named.join(s, (F.col("sid") == F.col("_sid")) & F.col("_doc").eqNullSafe(F.col("owner"))).select(
        "pivot", "salt", "sid", "is_member", "items")
    return full.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "is_member").mapInArrow(
        _overlaps, "pivot long, sid long, shared long")


def _block_links(percent):
    """Rows sorted by (block, is_pair): the sets of a block come before its pairs. Only pairs that link go on."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        block, sets = None, {}
        for b in batches:
            out = []
            for now, pair, sid, other, items in zip(*(b.column(c).to_pylist() for c in (
                    "block", "is_pair", "sid", "other", "items"))):
                if now != block:
                    block, sets = now, {}
                if not pair:
                    sets[sid] = np.frombuffer(items, np.uint64)
                else:
                    x, y = sets[sid], sets[other]
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    if (100 + percent) * int((x[at] == y).sum()) >= percent * (len(x) + len(y)):
                        out.append((sid, other))
            if out:
                yield table(schema, **dict(zip(("a", "b"), map(list, zip(*out)))))
    return run


def _compare_blocks(pairs: DataFrame, families: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int,
                    size: int = 256) -> DataFrame:
    """(a, b): the pairs that link, for many pairs among few sets.

    Sets with one pivot are a family, cut into parts of about `size`; a set is
    sent once for each part that it has a pair in, not once for each pair."""
    k = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("k"))
    part = stash(families.join(k, "family").select(
        "sid", F.xxhash64("family", F.pmod(F.xxhash64("sid"), F.col("k"))).alias("part")), "parts")
    named = stash(pairs.join(part.withColumnRenamed("part", "p1"), "sid").join(
        part.select(F.col("sid").alias("pivot"), F.col("part").alias("p2")), "pivot").select(
        F.xxhash64(F.least("p1", "p2"), F.greatest("p1", "p2")).alias("block"), "sid", "pivot"), "named")
    needed = named.select("block", "sid").unionByName(named.select("block", F.col("pivot").alias("sid"))).distinct()
    s = sets.withColumnRenamed("sid", "_sid")
    full = needed.join(nodes.select("sid", F.col("doc_id").alias("_doc")), "sid").join(
        s, (F.col("sid") == F.col("_sid")) & F.col("_doc").eqNullSafe(F.col("owner"))).select(
        "block", F.lit(False).alias("is_pair"), "sid", F.lit(None).cast("long").alias("other"), "items")
    rows = full.unionByName(named.select("block", F.lit(True).alias("is_pair"), "sid", F.col("pivot").alias("other"),
                                         F.lit(None).cast("binary").alias("items")))
    return rows.repartition("block").sortWithinPartitions("block", "is_pair").mapInArrow(
        _block_links(percent), "a long, b long")


def _may_link(pa_, na, pb, nb, percent):
    """Sizes and places allow the needed overlap, if this is the first shared shingle."""
    need = percent * (na + nb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (
        (100 + percent) * F.least(na - pa_, nb - pb) >= need)


def _prefixes_allow(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (sid, n, pivot, pn) that may link by what their prefixes share.

    The prefix that ends first in the order holds all that both have of it, so
    the overlap is at most that of the prefixes and all behind the prefix of one of the two."""
    held = nodes.select("sid", "prefix")
    shared = F.size(F.array_intersect("prefix", "other"))
    behind = F.greatest(*(F.floor((percent * F.col(c) + 99) / 100) - 1 for c in ("n", "pn")))
    return pairs.join(held, "sid").join(held.select(F.col("sid").alias("pivot"), F.col("prefix").alias("other")), "pivot").filter(
        (100 + percent) * (shared + behind) >= percent * (F.col("n") + F.col("pn"))).select(*pairs.columns)


def _mixed_lists(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Postings of the lists that hold sets of several components, with the component."""
    placed = postings.join(roots, F.col("sid") == F.col("node"), "left").select(
        "h", "sid", "n", "pos", F.coalesce("root", "sid").alias("comp"))
    mixed = stash(placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
                  .select("h"), "mixed")
    return stash(placed.join(mixed, "h"), "placed")


def _other_components(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """(sid, n, pivot, pn): for each set the `_MEET` sets of other components that it shares most lists with.

    Each list offers `_MEET` of its sets, others in each turn; ranks are limited
    before the shuffle, so that a list of any length sends few rows."""
    by_hash = Window.partitionBy("h").orderBy(F.xxhash64("sid", F.lit(turn)), "sid")
    heads = stash(placed.withColumn("r", F.row_number().over(by_hash)).filter(F.col("r") <= _MEET).select(
        "h", F.col("sid").alias("pivot"), F.col("n").alias("pn"), F.col("pos").alias("pp"),
        F.col("comp").alias("pcomp")), "heads")
    votes = placed.join(heads, "h").filter((F.col("comp") != F.col("pcomp")) & _may_link(
        F.col("pos"), F.col("n"), F.col("pp"), F.col("pn"), percent)).groupBy("sid", "n", "pivot", "pn").agg(
        F.count(F.lit(1)).alias("votes"))
    best = Window.partitionBy("sid").orderBy(F.desc("votes"), "pivot")
    return votes.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= _MEET).select("sid", "n", "pivot", "pn")


def _told_apart(n_keys: int, max_bits: int) -> tuple[float, int]:
    """Part of all shingles that goes into the filter of repeated ones, and its places for a shingle.

    With more shingles than bits, a filter of all would take nearly each for
    repeated. Most single ones are told with as many shingles as bits, one place each."""
    bits = bits_for(n_keys, max_bits)
    if n_keys <= bits // 2:
        return 1.0, 2
    return min(1.0, bits / n_keys), 1


def similar_components(docs: DataFrame, width: int = 5, percent: int = 80, max_bits: int = 1 << 28,
                       max_common: int = 1 << 17, rounds: int = 2, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row; two sets link at 100 * overlap >= percent * union.

    `max_common` bounds the table of frequent shingles and `rounds` the turns in
    which components grow before all pairs that are left are compared; both
    decide only the work, never the result."""
    spark = docs.sparkSession
    d = id_text(docs, id_col, text_col)
    common = d.mapInArrow(_frequent(width, 3), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(
        F.desc("n"), "h").limit(max_common).toPandas()
    h = common["h"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(h)
    shared = share(spark, (h[by], common["n"].to_numpy(np.int64)[by]))
    n_keys = count_keys(d, F.ceil(F.octet_length("text") / 6))
    part, n_places = _told_apart(n_keys, max_bits)
    repeated = fill_twice(d, _shingles(width, part), n_keys, max_bits, n_places=n_places)
    sketch = stash(d.mapInArrow(_sketch(width, percent, shared, repeated, part, n_places),
                                "doc_id long, sid long, n long, skip long, prefix array<long>"), "sketch")
    shared.unpersist()
    repeated.unpersist()
    # Equal sets are one node; reduced before the shuffle, so that copies do not meet.
    nodes = stash(sketch.filter("n > 0").groupBy("sid").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("skip").alias("skip"),
        F.first("prefix").alias("prefix")), "nodes")
    twice = fill_twice(nodes, _prefix_hashes, F.size("prefix"), max_bits, text=None)
    postings = stash(nodes.select("sid", "n", "skip", "prefix").mapInArrow(
        _postings(twice), "h long, sid long, n long, pos long"), "postings")
    twice.unpersist()

    # 1. One pivot for each set: the least set of a list, taken where most lists agree.
    lists = stash(postings.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("sid", "n", "pos")).alias("p"))
                  .filter("c > 1").select("h", F.col("p.sid").alias("pivot"), F.col("p.n").alias("pn"),
                                          F.col("p.pos").alias("pp")), "lists")
    near = postings.join(lists, "h").filter((F.col("sid") != F.col("pivot")) & _may_link(
        F.col("pos"), F.col("n"), F.col("pp"), F.col("pn"), percent))
    votes = near.groupBy("sid", "n", "pivot", "pn").agg(F.count(F.lit(1)).alias("votes"))
    first = stash(votes.groupBy("sid", "n").agg(F.max(F.struct("votes", -F.col("pivot"), "pivot", "pn")).alias("v"))
                  .select("sid", "n", F.col("v.pivot").alias("pivot"), F.col("v.pn").alias("pn")), "pivots")

    def sets_of(pairs):
        """Whole sets of the nodes in pairs, made anew from their texts; only they are shuffled, not texts."""
        wanted = pairs.select("sid").unionByName(pairs.select(F.col("pivot").alias("sid"))).distinct()
        wanted = stash(nodes.select("sid", "doc_id").join(wanted, "sid", "left_semi"), "wanted")
        ids = fill_ids(wanted)
        sets = stash(d.mapInArrow(_full_sets(width, ids), "sid long, owner long, items binary"), "sets")
        ids.unpersist()
        return wanted, sets

    def answers(pairs):
        """Exact overlaps of pairs with few pivots, where they may link; the sets are gone afterwards."""
        able = stash(_prefixes_allow(pairs, nodes, percent), "able")
        tables = sets_of(able)
        out = stash(_compare(able.select("pivot", "sid"), *tables).join(able, ["pivot", "sid"]), "answers")
        release(able, *tables)
        return out

    linked = lambda s, na, nb: (100 + percent) * s >= percent * (na + nb)
    known = answers(first)
    edges = known.filter(linked(F.col("shared"), F.col("n"), F.col("pn"))).select(
        F.col("sid").alias("a"), F.col("pivot").alias("b"))
    roots = stash(components(edges), "roots")
    placed = _mixed_lists(postings, roots)
    # 2. Sets of lists that still hold several components meet some sets of other components.
    for turn in range(rounds):
        more = answers(_other_components(placed, turn, percent))
        edges = edges.unionByName(more.filter(linked(F.col("shared"), F.col("n"), F.col("pn"))).select(
            F.col("sid").alias("a"), F.col("pivot").alias("b")))
        roots = stash(components(edges), "roots")
        # Lists of one component are settled; only the others go on.
        placed = _mixed_lists(placed.drop("comp"), roots)

    # 3. Pairs of different components, block against block.
    sizes = stash(placed.groupBy("h", "comp").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("long").alias("k")), "blocks")
    blocks = placed.join(sizes, ["h", "comp"]).groupBy(
        "h", "comp", F.floor(F.log("n") * 8).alias("size"), F.floor(F.col("pos") / 8).alias("deep"),
        F.pmod(F.xxhash64("sid"), F.col("k")).alias("salt")).agg(
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max(F.col("n") - F.col("pos")).alias("left"),
        F.collect_list(F.struct("sid", "n", "pos")).alias("sets"))
    blocks = stash(blocks.drop("size", "deep", "salt"), "blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    meet = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.comp") < F.col("b.comp"))
                  & (100 * F.col("a.n_hi") >= percent * F.col("b.n_lo"))
                  & (100 * F.col("b.n_hi") >= percent * F.col("a.n_lo"))
                  & ((100 + percent) * F.least("a.left", "b.left") >= percent * (F.col("a.n_lo") + F.col("b.n_lo"))))
    one = meet.select(F.explode("a.sets").alias("x"), F.col("b.sets").alias("ys"))
    pairs = one.select("x", F.explode(F.filter("ys", lambda y: _may_link(
        F.col("x.pos"), F.col("x.n"), y["pos"], y["n"], percent))).alias("y")).select(
        F.col("x.sid").alias("pivot"), F.col("x.n").alias("pn"), F.col("y.sid").alias("sid"), F.col("y.n").alias("n")
    ).distinct()

    # 4. What the overlaps with a common pivot settle, and the rest.
    answer = known.select(F.col("sid").alias("_s"), F.col("pivot").alias("_p"), F.col("shared").alias("_i"),
                          F.col("pn").alias("_n")).unionByName(
        known.groupBy("pivot").agg(F.first("pn").alias("_n")).select(
            F.col("pivot").alias("_s"), F.col("pivot").alias("_p"), F.col("_n").alias("_i"), "_n"))
    answer = stash(answer, "answers")
    two = pairs.join(answer.select(F.col("_s").alias("sid"), F.col("_p").alias("p1"), F.col("_i").alias("i1"), "_n"),
                     "sid", "left").join(
        answer.select(F.col("_s").alias("pivot"), F.col("_p").alias("p2"), F.col("_i").alias("i2")), "pivot", "left")
    same = F.coalesce(F.col("p1") == F.col("p2"), F.lit(False))
    most = F.least("i1", "i2") + F.least(F.col("n") - F.col("i1"), F.col("pn") - F.col("i2"))
    least = F.col("i1") + F.col("i2") - F.col("_n")
    verdict = F.when(same & ~linked(most, F.col("n"), F.col("pn")), "no").when(
        same & linked(least, F.col("n"), F.col("pn")), "yes").otherwise("compare")
    two = two.withColumn("verdict", verdict).groupBy("pivot", "sid", "n", "pn").agg(
        F.max_by("verdict", F.when(F.col("verdict") == "compare", 0).otherwise(1)).alias("verdict"))
    two = stash(two.filter("verdict <> 'no'"), "pairs")
    open_pairs = two.filter("verdict = 'compare'")
    among, whole = sets_of(open_pairs)
    families = among.select("sid").join(first.select("sid", "pivot"), "sid", "left").select(
        "sid", F.coalesce("pivot", "sid").alias("family"))
    late = _compare_blocks(open_pairs.select("pivot", "sid"), families, among, whole, percent).unionByName(
        two.filter("verdict = 'yes'").select(F.col("sid").alias("a"), F.col("pivot").alias("b")))
    every = stash(components(edges.unionByName(late)), "roots")
    release(among, whole, postings, placed, blocks, answer, two)

    joined = sketch.select("doc_id", "sid", "n").join(every, F.col("sid") == F.col("node"), "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "sid")).alias("comp"))
    joined = stash(joined, "members")
    # Only components of several rows need a shuffle; a row alone is its own.
    heads = stash(joined.filter("comp IS NOT NULL").groupBy("comp").agg(
        F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("comp", "head"), "heads")
    return joined.join(heads, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("head", "doc_id").alias("component_id"))
