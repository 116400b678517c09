"""The roster row of a person in the month of the expense."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _edge(text: str) -> Column:
    return F.lit(text).cast("date")


def line_salt(df: DataFrame) -> list[str]:
    """Columns that tell lines apart, as far as the table has them."""
    names = [c for c in ("source_seq", "row_no") if c in df.columns]
    return names or [c for c in ("doc_date", "amount") if c in df.columns]


def spread_null(key, *salt) -> Column:
    """Join key whose nulls are spread over many values that match nothing.

    Rows without a key would otherwise all hash to one partition of an outer
    join."""
    key = F.col(key) if isinstance(key, str) else key
    bucket = F.xxhash64(*salt).cast("string") if salt else F.lit("")
    return F.coalesce(key, F.concat(F.lit("\u0001"), bucket))


def intervals(snap: DataFrame) -> DataFrame:
    """One row per id and period with the dates it answers for.

    The first period also answers for everything before it, the last for
    everything after. An id without any period has one row for all dates."""
    rest = [c for c in snap.columns if c not in ("staff_id", "period")]
    per = snap.groupBy("staff_id", "period").agg(F.max_by(F.struct(*rest), "load_seq").alias("r"))
    w = Window.partitionBy("staff_id").orderBy(F.asc_nulls_last("period"))
    ranked = per.withColumns({
        "pos": F.row_number().over(w), "next": F.lead("period").over(w)})
    return (
        ranked.filter(F.col("period").isNotNull() | (F.col("pos") == 1))
        .select("staff_id", "period",
                F.when(F.col("pos") == 1, _edge("0001-01-01")).otherwise(F.col("period")).alias("valid_from"),
                F.coalesce("next", _edge("9999-12-31")).alias("valid_to"), "r.*")
    )


def as_of(lines: DataFrame, snap: DataFrame, prefix: str = "") -> DataFrame:
    """Attach the latest roster row at or before the document date.

    Adds the roster columns (prefixed) and `relation`: same_month, earlier,
    roster_stale, before_first or undated; null when the id has no row."""
    iv = intervals(snap)
    names = [c for c in iv.columns if c not in ("staff_id", "valid_from", "valid_to")]
    right = iv.select(F.col("staff_id").alias("_id"), "valid_from", "valid_to",
                      *[F.col(c).alias(f"_{c}") for c in names])
    left = lines.withColumns({
        "_key": spread_null("staff_id", *line_salt(lines)),
        "_on": F.coalesce("doc_date", _edge("9999-12-30"))})
    j = left.join(right, (F.col("_key") == F.col("_id")) & (F.col("_on") >= F.col("valid_from"))
                  & (F.col("_on") < F.col("valid_to")), "left")
    last = snap.agg(F.max("period")).scalar()
    month = lambda c: F.trunc(c, "month")
    rel = (
        F.when(F.col("_id").isNull(), None)
        .when(F.col("doc_date").isNull() | F.col("_period").isNull(), "undated")
        .when(F.col("doc_date") < F.col("_period"), "before_first")
        .when(month("doc_date") == month("_period"), "same_month")
        .when(month("doc_date") > month(last), "roster_stale")
        .otherwise("earlier")
    )
    return j.select(*lines.columns, *[F.col(f"_{c}").alias(f"{prefix}{c}") for c in names],
                    rel.alias("relation"))


def fallback_secondary(lines: DataFrame, secondary: DataFrame, cols=("site", "company", "company2")) -> DataFrame:
    """The undated secondary row when the id is not in the snapshots."""
    right = secondary.select(F.col("staff_id").alias("_sid"), *[F.col(c).alias(f"sec_{c}") for c in cols])
    j = lines.withColumn("_key", spread_null("staff_id", *line_salt(lines))).join(
        right, F.col("_key") == F.col("_sid"), "left")
    use = F.col("relation").isNull() & F.col("_sid").isNotNull()
    return j.withColumns({
        **{c: F.when(use, F.col(f"sec_{c}")).otherwise(F.col(c)) for c in cols},
        "relation": F.when(use, "secondary").otherwise(F.col("relation"))}).drop("_key", "_sid")
