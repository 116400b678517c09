"""Payments that arrive in more than one feed.

A bucket is date, absolute amount and currency. In a bucket that several
feeds share, one feed is kept whole and every other feed pairs its lines one
to one with the kept ones; a paired line is removed. A bucket, a name or a
set of copies may be very large: ranks run over row blocks, choices over
aggregates, and no step builds all pairs of a bucket or brings one bucket
into one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import currency_key, letter_sig, name_norm, source_name, tokens
from ..functions.values import CENTS, cents
from .common import block_row_number, cut_lineage, top_per_group

BUCKET = ["doc_date", "abs_amount", "ccy"]
LINE = ["source_seq", "row_no"]

# Six letter groups of similar weight. Up to four surplus letters change at most
# four groups, so two names within that distance agree on at least two.
LETTER_GROUPS = ("ADYWX", "EUOJQ", "ITHF", "NSBP", "LKCV", "RMGZ")
MAX_GAP = 4


def prepare(lines: DataFrame) -> DataFrame:
    """Feed name, currency, name keys and the bucket columns."""
    label = F.col("source_label") if "source_label" in lines.columns else None
    priority = F.lit(V.OTHER_PRIORITY)
    for kind, p in V.SOURCE_PRIORITY.items():
        priority = F.when(F.col("source_type") == kind, p).otherwise(priority)
    norm = name_norm("person_raw")
    return lines.withColumns({
        "feed": source_name("source_file", label),
        "ccy": currency_key("currency"),
        "pnorm": norm,
        "sig": letter_sig(norm),
        "abs_amount": F.abs(cents("amount")),
        "prio": priority,
        "no_center": (F.coalesce("cost_center", F.lit("")) == "").cast("int"),
        "not_auto": (F.coalesce("decision", F.lit("")) != V.AUTO).cast("int"),
    })


def keep_feed(prepared: DataFrame) -> DataFrame:
    """The feed to keep in each bucket that more than one feed shares."""
    dated = prepared.filter(F.col("doc_date").isNotNull() & F.col("abs_amount").isNotNull())
    return dated.groupBy(*BUCKET).agg(
        F.min(F.struct("prio", "no_center", "not_auto", "feed")).alias("best"),
        F.min("feed").alias("lo"), F.max("feed").alias("hi"),
    ).filter(F.col("lo") != F.col("hi")).select(*BUCKET, F.col("best.feed").alias("keep"))


def is_cut_of(short, long) -> Column:
    """Letters of the shorter signature all occur in the longer one, gap at most 4."""
    s, l = F.col(short), F.col(long)
    a = F.when(F.length(s) <= F.length(l), s).otherwise(l)
    b = F.when(F.length(s) <= F.length(l), l).otherwise(s)
    return (F.length(b) - F.length(a) <= MAX_GAP) & F.rlike(b, F.concat_ws(".*", F.split(a, "")))


def pair_score(a_sig, b_sig, a_toks, b_toks) -> Column:
    """D3: 3 same letters, 2 truncated, 1 a shared word, 0 otherwise."""
    named = (F.col(a_sig) != "") & (F.col(b_sig) != "")
    return (
        F.when(named & (F.col(a_sig) == F.col(b_sig)), 3)
        .when(named & is_cut_of(a_sig, b_sig), 2)
        .when(named & F.arrays_overlap(a_toks, b_toks), 1)
        .otherwise(0)
    )


def _near_keys(sig) -> Column:
    """All pairs of letter groups of a signature, as join keys for tier 2."""
    parts = [F.regexp_replace(F.col(sig), f"[^{g}]", "") for g in LETTER_GROUPS]
    keys = []
    for i in range(len(parts)):
        for j in range(i + 1, len(parts)):
            keys.append(F.concat(F.lit(f"{i}{j}:"), parts[i], F.lit("|"), parts[j]))
    return F.array(*keys)


def _loose_keys(side: str) -> Column:
    """Keys under which one shared word is enough.

    Raw ledger against its distributed copy, or two attachments of one message."""
    other = {V.TRAVEL_LEDGER: V.DISTRIBUTED, V.DISTRIBUTED: V.TRAVEL_LEDGER}
    own = F.col("source_type")
    pair = F.lit(None).cast("string")
    for a, b in other.items():
        pair = F.when(own == a, a if side == "other" else b).otherwise(pair)
    message = F.when(F.col("source_file").contains("> "), F.substring_index("source_file", "> ", 1))
    marks = F.filter(F.array(F.concat(F.lit("T|"), pair), F.concat(F.lit("M|"), message)),
                     lambda x: x.isNotNull())
    return F.flatten(F.transform(marks, lambda m: F.transform(
        "toks", lambda t: F.concat(m, F.lit("|"), t))))


def first_fit(others: DataFrame, kept: DataFrame, group) -> DataFrame:
    """Give every other row, in order, the first free kept row that shares a key.

    `others` has group, key, o (order struct); `kept` has group, key, k. Every
    round settles, by aggregates over keys, all pairs no earlier row can touch:
    the first free kept row of a line whose own first free line it is. A key
    whose rows have no other key is settled whole, k-th with k-th. What is
    left shrinks until no key has both sides."""
    pairs = None
    on = [*group, "key"]
    while True:
        both = others.groupBy(*on).agg(F.min("o").alias("first_o")).join(
            kept.groupBy(*on).agg(F.min("k").alias("first_k")), on)
        o = others.join(both, on)
        k = kept.join(both, on)
        ow = o.groupBy(*group, "o").agg(F.count(F.lit(1)).alias("n_o"))
        kw = k.groupBy(*group, "k").agg(F.count(F.lit(1)).alias("n_k"))
        # Keys whose rows, on both sides, carry this key alone.
        o1 = o.join(ow, [*group, "o"])
        k1 = k.join(kw, [*group, "k"])
        lone = o1.groupBy(*on).agg(F.max("n_o").alias("mo")).join(
            k1.groupBy(*on).agg(F.max("n_k").alias("mk")), on).filter("mo = 1 and mk = 1").select(*on)
        ro = block_row_number(o1.join(lone, on, "left_semi").select(*on, "o", "o.*"), on,
                              ["seq", "row"], "rn").select(*on, "rn", "o")
        rk = block_row_number(k1.join(lone, on, "left_semi").select(*on, "k", "k.*"), on,
                              ["no_center", "not_auto", "seq", "row"], "rn").select(*on, "rn", "k")
        whole = ro.join(rk, [*on, "rn"]).select(*group, "o", "k")
        best_o = o.groupBy(*group, "o").agg(F.min("first_k").alias("k"))
        best_k = k.groupBy(*group, "k").agg(F.min("first_o").alias("o"))
        mutual = best_o.join(best_k, [*group, "o", "k"]).select(*group, "o", "k")
        won = cut_lineage(whole.unionByName(mutual).distinct())
        if won.isEmpty():
            return pairs
        pairs = won if pairs is None else pairs.unionByName(won)
        others = cut_lineage(o.drop("first_o", "first_k").join(won.select(*group, "o"), [*group, "o"], "left_anti")
                             .select(*on, "o"))
        kept = cut_lineage(k.drop("first_o", "first_k").join(won.select(*group, "k"), [*group, "k"], "left_anti")
                           .select(*on, "k"))


def pair_lines(prepared: DataFrame) -> DataFrame:
    """One-to-one pairs (removed line, kept line) with their tier.

    Tier 3 (same letters) and lines without a name (tier 0) pair the k-th with
    the k-th. Tiers 2 and 1 take what is left, in that order."""
    keep = keep_feed(prepared)
    shared = cut_lineage(prepared.join(keep, BUCKET).select(
        *BUCKET, "keep", "feed", "sig", "pnorm", "source_type", "source_file", "source_seq", "row_no",
        "no_center", "not_auto", "amount", "prio", "person_raw"))
    kept = shared.filter(F.col("feed") == F.col("keep"))
    other = shared.filter(F.col("feed") != F.col("keep"))
    k = block_row_number(kept.select(*BUCKET, "sig", "no_center", "not_auto", *LINE), [*BUCKET, "sig"],
                         ["no_center", "not_auto", *LINE], "rn")
    o = block_row_number(other.select(*BUCKET, "sig", "feed", *LINE), [*BUCKET, "feed", "sig"], LINE, "rn")
    k = k.select(*BUCKET, "sig", "rn", F.col("source_seq").alias("k_seq"), F.col("row_no").alias("k_row"))
    o = o.select(*BUCKET, "sig", "rn", "feed", F.col("source_seq").alias("o_seq"), F.col("row_no").alias("o_row"))
    tier = F.when(F.col("sig") == "", 0).otherwise(3)
    out = cut_lineage(o.join(k, [*BUCKET, "sig", "rn"]).select(
        *BUCKET, "feed", "o_seq", "o_row", "k_seq", "k_row", tier.alias("tier")))

    group = [*BUCKET, "feed"]
    for level in (2, 1):
        taken_o = out.select(F.col("o_seq").alias("source_seq"), F.col("o_row").alias("row_no"))
        left_o = other.filter("sig <> ''").join(taken_o, LINE, "left_anti")
        open_feeds = left_o.select(*BUCKET, F.col("feed").alias("of")).distinct()
        # Only kept rows of buckets that still wait, once per waiting feed.
        left_k = kept.filter("sig <> ''").join(open_feeds, BUCKET).join(
            out.select(F.col("feed").alias("of"), F.col("k_seq").alias("source_seq"), F.col("k_row").alias("row_no")),
            ["of", *LINE], "left_anti")
        left_k = left_k.drop("feed").withColumnRenamed("of", "feed")
        left_o = cut_lineage(left_o)
        if left_o.isEmpty():
            break
        left_k = cut_lineage(left_k)
        order_o = F.struct(F.col("source_seq").alias("seq"), F.col("row_no").alias("row")).alias("o")
        order_k = F.struct("no_center", "not_auto", F.col("source_seq").alias("seq"),
                           F.col("row_no").alias("row")).alias("k")
        if level == 2:
            # Candidate spellings by two equal letter groups, once per distinct spelling.
            so = left_o.select(*group, F.col("sig").alias("osig")).distinct()
            sk = left_k.select(*group, F.col("sig").alias("ksig")).distinct()
            near = so.withColumn("nk", F.explode(_near_keys("osig"))).join(
                sk.withColumn("nk", F.explode(_near_keys("ksig"))), [*group, "nk"])
            near = near.select(*group, "osig", "ksig").distinct().filter(is_cut_of("osig", "ksig"))
            oo = left_o.join(near.withColumnRenamed("osig", "sig"), [*group, "sig"]).select(
                *group, F.col("ksig").alias("key"), order_o)
            kk = left_k.select(*group, F.col("sig").alias("key"), order_k)
        else:
            oo = left_o.withColumn("toks", tokens("pnorm")).select(
                *group, F.explode(_loose_keys("other")).alias("key"), order_o)
            kk = left_k.withColumn("toks", tokens("pnorm")).select(
                *group, F.explode(_loose_keys("kept")).alias("key"), order_k)
        got = first_fit(cut_lineage(oo), cut_lineage(kk), group)
        if got is not None:
            out = out.unionByName(got.select(
                *group, F.col("o.seq").alias("o_seq"), F.col("o.row").alias("o_row"),
                F.col("k.seq").alias("k_seq"), F.col("k.row").alias("k_row"), F.lit(level).alias("tier")))
    return out


def eliminate(prepared: DataFrame, enabled: bool = True):
    """(kept lines, pairs). Kept lines inherit shares, label and centre proposal
    of the lines removed for them, in separate columns."""
    lines = prepared
    if not enabled:
        none = F.lit(None)
        kept = lines.withColumns({"inherited_shares": none.cast(lines.schema["shares"].dataType),
                                  "inherited_label": none.cast("string"),
                                  "center_proposal": none.cast("string")})
        return kept, None
    pairs = cut_lineage(pair_lines(lines))
    gone = pairs.select(F.col("o_seq").alias("source_seq"), F.col("o_row").alias("row_no"))
    # Only removed lines are looked at, so this side is as small as the pairs.
    removed = lines.join(pairs.select(F.col("o_seq").alias("source_seq"), F.col("o_row").alias("row_no"),
                                      "k_seq", "k_row"), LINE)
    at = F.struct("prio", "feed", *LINE)
    has_shares = F.size(F.coalesce("shares", F.array().cast(lines.schema["shares"].dataType))) > 0
    left = removed.groupBy("k_seq", "k_row").agg(
        F.max_by(F.when(has_shares, F.col("shares")), F.when(has_shares, at)).alias("i_shares"),
        F.max_by("site_label", F.when(F.coalesce("site_label", F.lit("")) != "", at)).alias("i_label"),
        F.max_by("cost_center", F.when(F.coalesce("cost_center", F.lit("")) != "", at)).alias("i_center"))
    left = left.select(F.col("k_seq").alias("source_seq"), F.col("k_row").alias("row_no"),
                       "i_shares", "i_label", "i_center")
    kept = lines.join(gone, LINE, "left_anti").join(left, LINE, "left")
    kept = kept.withColumns({
        "inherited_shares": F.when(~has_shares, F.col("i_shares")),
        "inherited_label": F.when(F.coalesce("site_label", F.lit("")) == "", F.col("i_label")),
        "center_proposal": F.when(F.coalesce("cost_center", F.lit("")) == "", F.col("i_center")),
    }).drop("i_shares", "i_label", "i_center")
    return kept, pairs


def paired(prepared: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides of every pair with feed, person and amount."""
    cols = ["feed", "person_raw", "amount"]
    side = lambda p: prepared.select(
        F.col("source_seq").alias(f"{p}_seq"), F.col("row_no").alias(f"{p}_row"),
        *[F.col(c).alias(f"{p}_{c}") for c in cols])
    return pairs.drop("feed").join(side("o"), ["o_seq", "o_row"]).join(side("k"), ["k_seq", "k_row"])


def sign_conflicts(both: DataFrame) -> DataFrame:
    """The two sides of a pair have opposite signs; zero counts as positive."""
    return both.filter((F.col("k_amount") >= 0) != (F.col("o_amount") >= 0)).select(
        "doc_date", F.coalesce(F.nullif("k_person_raw", F.lit("")), "o_person_raw").alias("person"),
        F.col("ccy").alias("currency"), F.col("k_feed").alias("kept_feed"), F.col("o_feed").alias("removed_feed"),
        cents("k_amount").alias("kept_amount"), cents("o_amount").alias("removed_amount"))


_SUSPICION = ["feed", "person", "doc_date", "amount", "ccy", "other_feed", "other_amount", "reason"]


def weak_pairs(both: DataFrame) -> DataFrame:
    """Pairs removed on one shared word: reported for review."""
    return both.filter("tier = 1").select(
        F.col("o_feed").alias("feed"), F.col("o_person_raw").alias("person"), "doc_date",
        cents("o_amount").alias("amount"), "ccy", F.col("k_feed").alias("other_feed"),
        cents("k_amount").alias("other_amount"), F.lit("one_word").alias("reason"))


def amount_changed(kept: DataFrame, pairs: DataFrame, prepared: DataFrame = None) -> DataFrame:
    """Same person and date in another feed with another amount.

    Only feeds that lost a line are examined. Per person, date and feed two
    different amounts are enough to find the first counterpart of any line."""
    c = kept.filter("sig <> '' and abs_amount is not null").withColumn(
        "day", F.coalesce("doc_date", F.lit("0001-01-01").cast("date")))
    firsts = c.groupBy("sig", "day", "feed", "abs_amount").agg(
        F.min(F.struct("source_seq", "row_no", "amount")).alias("at"))
    firsts = top_per_group(firsts, ["sig", "day", "feed"], ["at"], 2).select(
        "sig", "day", F.col("feed").alias("f2"), F.col("abs_amount").alias("a2"), "at")
    touched = pairs.select("feed").distinct()
    classes = c.join(touched, "feed", "left_semi").select("sig", "day", "feed", "abs_amount").distinct()
    hit = classes.join(firsts, ["sig", "day"]).filter(
        (F.col("f2") != F.col("feed")) & (F.col("a2") != F.col("abs_amount")))
    hit = hit.groupBy("sig", "day", "feed", "abs_amount").agg(F.min(F.struct("f2", "at")).alias("b"))
    return c.join(hit, ["sig", "day", "feed", "abs_amount"]).select(
        "feed", F.col("person_raw").alias("person"), "doc_date", cents("amount").alias("amount"), "ccy",
        F.col("b.f2").alias("other_feed"), cents("b.at.amount").alias("other_amount"),
        F.lit("amount_changed").alias("reason"))


def undated_repeats(kept: DataFrame) -> DataFrame:
    """Undated, same amount, currency and person in two feeds; all but the first."""
    c = kept.filter("doc_date is null and sig <> '' and abs_amount is not null")
    key = ["abs_amount", "ccy", "sig"]
    g = c.groupBy(*key).agg(
        F.min(F.struct("source_seq", "row_no", "feed", "amount")).alias("first"),
        F.min("feed").alias("lo"), F.max("feed").alias("hi")).filter("lo <> hi")
    j = c.join(g, key).filter(~((F.col("first.source_seq") == F.col("source_seq"))
                                & (F.col("first.row_no") == F.col("row_no"))))
    return j.select("feed", F.col("person_raw").alias("person"), "doc_date", cents("amount").alias("amount"),
                    "ccy", F.col("first.feed").alias("other_feed"), cents("first.amount").alias("other_amount"),
                    F.lit("undated_repeat").alias("reason"))


def suspicions(prepared: DataFrame, kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """All three kinds of suspicion. Changed amounts and undated repeats are looked for
    only once something was removed."""
    any_pair = pairs.limit(1).select(F.lit(1).alias("_any"))
    undated = undated_repeats(kept).join(any_pair, F.lit(True), "left_semi")
    return weak_pairs(paired(prepared, pairs)).unionByName(amount_changed(kept, pairs)).unionByName(undated)


def overlap_warnings(control: DataFrame) -> DataFrame:
    """Feeds of which half but not all was duplicate."""
    share = F.col("n_duplicate") / F.col("n_lines")
    return control.filter((F.col("n_lines") > 0) & (share >= 0.5) & (share < 1.0)).select(
        "feed", "currency", "n_lines", "n_duplicate", (F.col("n_lines") - F.col("n_duplicate")).alias("n_alone"))
