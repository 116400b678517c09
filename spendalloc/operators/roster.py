"""Roster indexes and statistics."""

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.similarity import token_set_ratio
from ..functions.text import name_norm, token_key, tokens
from .common import cut_lineage, release, top_per_group
from .similar import similar_pairs


def latest(snap: DataFrame) -> DataFrame:
    """Newest row per id; rows without a period lose unless all lack one."""
    order = F.struct(F.coalesce("period", F.lit("0001-01-01").cast("date")), F.col("load_seq"))
    rest = [c for c in snap.columns if c != "staff_id"]
    return snap.groupBy("staff_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("staff_id", "r.*")


def name_index(snap: DataFrame) -> DataFrame:
    """R2: distinct (name, id) over all periods, so former names still match."""
    return (
        snap.withColumn("norm", name_norm("full_name"))
        .filter(F.col("norm") != "")
        .groupBy("norm", "staff_id")
        .agg(F.min("load_seq").alias("seq"))
        .withColumn("tkey", token_key("norm"))
    )


def roster_names(index: DataFrame) -> DataFrame:
    """Distinct names with their token set and first word."""
    return index.select("norm").distinct().withColumns({
        "toks": tokens("norm"), "tkey": token_key("norm"), "surname": F.substring_index("norm", " ", 1)})


def token_freq(names: DataFrame) -> DataFrame:
    """Document frequency of each token."""
    return names.select(F.explode("toks").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("freq"))


def token_index(names: DataFrame) -> DataFrame:
    """Token to name, with the token's frequency.

    Counts are joined back instead of a window: a common token is one row on
    the counted side and is split like any skewed join on the other."""
    pairs = names.select(F.explode("toks").alias("token"), "norm", "toks", "surname")
    return pairs.join(token_freq(names), "token")


def surname_stats(names: DataFrame) -> DataFrame:
    """How often a token is the first word of a name it occurs in."""
    return (
        names.select(F.explode("toks").alias("token"), "surname")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n_names"),
             F.count_if(F.col("token") == F.col("surname")).alias("n_surname"))
        .withColumn("probability", F.col("n_surname") / F.col("n_names"))
    )


def roster_profile(snap: DataFrame) -> DataFrame:
    """Size, gaps and name collisions of the roster, one row."""
    named = F.coalesce(F.col("full_name"), F.lit("")) != ""
    base = snap.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("staff_id").alias("n_ids"),
        F.count_distinct(F.when(named, F.col("staff_id"))).alias("n_named_ids"),
        F.count_if(~named).alias("n_nameless_rows"),
        F.count_distinct("period").alias("n_periods"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count_distinct("site").alias("n_sites"),
    )
    per_name = name_index(snap).groupBy("norm").agg(F.count(F.lit(1)).alias("n"))
    clash = per_name.agg(
        F.count(F.lit(1)).alias("n_names"),
        F.count_if(F.col("n") > 1).alias("n_colliding_names"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_colliding_ids"),
    )
    # Two one-row tables side by side.
    return base.join(clash, F.lit(True))


def secondary_profile(sec: DataFrame, k: int = 10) -> DataFrame:
    """Persons per company of the secondary roster, the k largest."""
    return (
        sec.groupBy(F.coalesce("company2", F.lit("?")).alias("company"))
        .agg(F.count(F.lit(1)).alias("n_persons"))
        .orderBy(F.desc("n_persons"), "company").limit(k)
    )


class Roster:
    """The roster and everything the identity steps look up in it.

    Each index is written once, when a step first reads it, and shared by all
    steps; one that no step reads takes neither time nor disk."""

    def __init__(self, snap: DataFrame):
        self._snap = snap

    def write(self) -> "Roster":
        """Write the indexes that read the roster's own rows, so that these may go."""
        self.latest, self.ids
        return self

    def release(self) -> None:
        """Remove the written indexes, when nothing reads them any more; the roster's own rows stay."""
        release(*(t for k, t in vars(self).items() if k != "_snap" and hasattr(t, "table_path")))

    @cached_property
    def latest(self) -> DataFrame:
        """Newest row per id, with latest_norm; only the columns that steps read."""
        read = ("staff_id", "full_name", "site", "period", "citizenship", "load_seq")
        snap = self._snap.select(*(c for c in self._snap.columns if c in read))
        return cut_lineage(latest(snap).withColumn("latest_norm", name_norm("full_name")))

    @cached_property
    def ids(self) -> DataFrame:
        """norm, staff_id, seq, tkey."""
        return cut_lineage(name_index(self._snap))

    @cached_property
    def names(self) -> DataFrame:
        """norm, toks, tkey, surname."""
        return cut_lineage(roster_names(self.ids))

    @cached_property
    def freq(self) -> DataFrame:
        """token, freq."""
        return cut_lineage(token_freq(self.names))

    @cached_property
    def by_token(self) -> DataFrame:
        """token, norm, toks, surname, freq."""
        pairs = self.names.select(F.explode("toks").alias("token"), "norm", "toks", "surname")
        return cut_lineage(pairs.join(self.freq, "token"))

    @cached_property
    def surnames(self) -> DataFrame:
        """token, n_names, n_surname, probability."""
        return surname_stats(self.names)


def build_roster(snap: DataFrame) -> Roster:
    """Indexes over one roster."""
    return Roster(snap)


def search(queries: DataFrame, roster: Roster, k: int = 10) -> DataFrame:
    """Free search of persons, the best k per query.

    An id answers alone. Else exact names come first, then names sharing a
    word (shortest first), then similar names: all at 82 or more, and those at
    70 or more that share a word start of four letters."""
    norm = name_norm("query")
    q = queries.select("query").distinct().withColumns({
        "norm": norm, "tkey": token_key(norm), "qtoks": tokens(norm)})

    def tier(d, n, order):
        return d.select("query", "staff_id", F.lit(n).alias("tier"), order.cast("double").alias("rank_by"))

    by_id = tier(q.join(roster.latest.select("staff_id"), F.trim("query") == F.col("staff_id")), 1, F.lit(0))
    open_q = q.join(by_id.select("query"), "query", "left_anti").filter("norm <> ''")
    exact = tier(open_q.join(roster.ids.select("tkey", "staff_id"), "tkey"), 2, F.lit(0))
    words = open_q.withColumn("token", F.explode("qtoks"))
    holders = roster.ids.select(F.col("norm").alias("rnorm"), "staff_id")
    # The best k of a word are the best k for every query with it: only they are joined.
    of_word = top_per_group(roster.by_token.select("token", F.col("norm").alias("rnorm")).join(holders, "rnorm").select(
        "token", "staff_id", F.length("rnorm").alias("n")), ["token"], ["n", "staff_id"], k)
    sharing = tier(words.join(of_word, "token"), 3, F.col("n"))
    sure = cut_lineage(by_id.unionByName(exact).unionByName(sharing).groupBy("query", "staff_id").agg(
        F.min(F.struct("tier", "rank_by")).alias("b")))
    # Similar names come last, so only queries that still lack persons look for them.
    full = sure.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = cut_lineage(words.join(full, "query", "left_anti").join(by_id.select("query"), "query", "left_anti"))
    prefix = F.left(F.col("token"), F.lit(V.PREFIX_MIN))
    similar = (
        short.withColumn("p4", prefix)
        .join(roster.by_token.select(prefix.alias("p4"), F.col("norm").alias("rnorm")), "p4")
        .select("norm", "rnorm").unionByName(similar_pairs(
            short.select("norm"), roster.names.select(F.col("norm").alias("rnorm")), V.FUZZY_MIN - V.FUZZY_LEAD))
        .distinct().withColumn("score", token_set_ratio("norm", "rnorm")).filter("score >= 70")
    )
    similar = tier(similar.join(short.select("query", "norm").distinct(), "norm").join(holders, "rnorm"), 4, -F.col("score"))
    hits = sure.select("query", "staff_id", "b.*").unionByName(similar.select("query", "staff_id", "tier", "rank_by"))
    hits = hits.groupBy("query", "staff_id").agg(F.min(F.struct("tier", "rank_by")).alias("b"))
    hits = hits.select("query", "staff_id", "b.*")
    return top_per_group(hits, ["query"], ["tier", "rank_by", "staff_id"], k, "position")
