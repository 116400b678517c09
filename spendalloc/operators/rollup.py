"""Rollups and reports over allocation rows and resolved lines."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import currency_key, fold, squeeze
from ..functions.values import CENTS, cents
from .allocate import person_key

PCT = "decimal(12,2)"


def _pct(part, whole) -> Column:
    p, w = F.col(part).cast("double"), F.col(whole).cast("double")
    return F.coalesce(F.when(w != 0, F.round(p / w * 100, 2)), F.lit(0)).cast(PCT)


def by_center(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Centres over all feeds. Persons are counted on the parts, since distinct
    persons of single rows do not add up; shares use absolute amounts."""
    key = ["cost_center", "currency"]
    sums = rows.groupBy(*key).agg(
        F.sum("amount").cast(CENTS).alias("amount"),
        *[F.sum(c).alias(c) for c in ("n_lines", "n_auto", "n_review", "n_unmatched")],
        F.bool_and("in_map").alias("in_map"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("company", F.lit("")))), "; ").alias("companies"))
    persons = parts.groupBy("cost_center", F.col("ccy").alias("currency")).agg(
        F.count_distinct(person_key()).alias("n_persons"))
    whole = sums.groupBy("currency").agg(F.sum(F.abs("amount")).alias("_whole"))
    out = sums.join(persons, key, "left").join(whole, "currency").withColumn("_abs", F.abs("amount"))
    return out.withColumn("share_pct", _pct("_abs", "_whole")).drop("_abs", "_whole")


def company_label() -> Column:
    return F.coalesce(F.nullif("company", F.lit("")), F.when(
        F.col("cost_center") == V.UNALLOCATED, "(unallocated)").otherwise("(no company)"))


def by_company(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Companies, and the projects below each, in one grouping-sets pass.

    A company's share is of its currency, a project's share of its company;
    both keep the sign."""
    sets = [["firm", "currency"], ["firm", "currency", "cost_center"]]

    def grouped(df, *aggs):
        d = df.withColumn("firm", company_label())
        return d.groupingSets([[F.col(c) for c in s] for s in sets], "firm", "currency", "cost_center").agg(
            *aggs, F.grouping("cost_center").alias("is_company")).withColumn(
            "cost_center", F.coalesce("cost_center", F.lit("")))

    sums = grouped(rows, F.sum("amount").cast(CENTS).alias("amount"), F.sum("n_lines").alias("n_lines"))
    persons = grouped(parts.withColumn("currency", F.col("ccy")),
                      F.count_distinct(person_key()).alias("n_persons"))
    key = ["firm", "currency", "cost_center", "is_company"]
    firms = sums.filter("is_company = 1")
    whole = firms.groupBy("currency").agg(F.sum("amount").alias("_cur"))
    above = firms.select("firm", "currency", F.col("amount").alias("_firm"))
    out = sums.join(persons, key, "left").join(whole, "currency").join(above, ["firm", "currency"])
    out = out.withColumn("_whole", F.when(F.col("is_company") == 1, F.col("_cur")).otherwise(F.col("_firm")))
    return out.withColumn("share_pct", _pct("amount", "_whole")).select(
        F.col("firm").alias("company"), "currency", "cost_center",
        F.when(F.col("is_company") == 1, "company").otherwise("project").alias("level"),
        "amount", "n_lines", "n_persons", "share_pct")


def run_summary(lines: DataFrame) -> DataFrame:
    """All counts of a run as (metric, key, n_lines, amount), one pass and one shuffle."""
    ccy = currency_key("currency")
    item = lambda m, k: F.struct(F.lit(m).alias("metric"), k.alias("key"))
    unmatched = F.when(F.col("decision") == V.UNMATCHED, F.nullif(F.trim("person_raw"), F.lit("")))
    items = F.array(
        item("decision", F.col("decision")),
        item("method", F.coalesce("method", F.lit("none"))),
        item("category", F.coalesce(F.nullif("category", F.lit("")), F.lit(V.DEFAULT_CATEGORY))),
        item("source_type", F.coalesce(F.nullif("source_type", F.lit("")), F.lit(V.GENERIC))),
        item("cost_center", F.concat_ws(" ", F.coalesce("cost_center", F.lit("(none)")), ccy)),
        item("currency", ccy),
        item("unmatched_person", unmatched))
    rows = lines.select(F.explode(items).alias("i"), "amount").select("i.*", "amount").filter("key is not null")
    return rows.groupBy("metric", "key").agg(
        F.count(F.lit(1)).alias("n_lines"), cents(F.sum("amount")).alias("amount"))


def label_summary(lines: DataFrame) -> DataFrame:
    """U4: how the feeds' labels compare with the resolved project."""
    kind = (F.when(F.col("label_class").isin("agrees", "unknown"), "agrees")
            .otherwise(F.col("label_class")))
    return lines.groupBy(kind.alias("label_class")).agg(F.count(F.lit(1)).alias("n_lines"))


def feed_share(rows: DataFrame) -> DataFrame:
    """Share of each allocation row in its feed and currency, as a fraction."""
    whole = rows.groupBy("feed", "currency").agg(F.sum("amount").alias("_whole"))
    ratio = F.coalesce(F.when(F.col("_whole") != 0, F.round(
        F.col("amount").cast("double") / F.col("_whole").cast("double"), 4)), F.lit(0))
    return rows.join(whole, ["feed", "currency"]).withColumn("feed_share", ratio.cast("decimal(12,4)")).drop("_whole")


def period_label(first="first_date", last="last_date") -> Column:
    """Month or month range of a row."""
    a, b = F.date_format(first, "MM.yyyy"), F.date_format(last, "MM.yyyy")
    return F.when(F.col(first).isNull(), "").when(F.col(last).isNull() | (a == b), a).otherwise(
        F.concat(a, F.lit(" - "), b))


def main_month(lines: DataFrame) -> DataFrame:
    """The month most lines fall in, one row; the earlier month wins a tie."""
    m = lines.filter("doc_date is not null and amount is not null").groupBy(
        F.trunc("doc_date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n_lines"))
    return m.orderBy(F.desc("n_lines"), "month").limit(1)


def with_totals(rows: DataFrame) -> DataFrame:
    """Allocation rows with a total row per feed and per currency, never across currencies."""
    return rows.groupingSets(
        [[F.col("currency"), F.col("feed"), F.col("cost_center")], [F.col("currency"), F.col("feed")],
         [F.col("currency")]], "currency", "feed", "cost_center").agg(
        F.sum("amount").cast(CENTS).alias("amount"), F.sum("n_lines").alias("n_lines"),
        F.grouping_id().alias("level"))


def suggest_map(lines: DataFrame, keys: DataFrame, staff: DataFrame) -> DataFrame:
    """U8: a map row for every unmapped site, largest amount first.

    Company by majority of the staff rows at the site; a readable code from
    the words of the site, made unique against the map and among themselves.
    staff has site, company, company2, load_seq."""
    from .centers import missing_sites

    norm = lambda c: squeeze(fold(c))
    used = lines.filter(~F.coalesce("in_map", F.lit(False)) & (F.coalesce("site", F.lit("")) != ""))
    used = used.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_lines"), cents(F.coalesce(F.sum("amount"), F.lit(0))).alias("amount"),
        F.min_by("currency", F.when(F.col("amount").isNotNull(), F.struct("source_seq", "row_no"))).alias("currency"))
    used = used.join(missing_sites(used, keys), "site", "left_semi").withColumn("_site", norm("site"))
    firm = F.nullif(F.trim(F.coalesce(F.nullif("company2", F.lit("")), F.col("company"))), F.lit(""))
    at = staff.withColumns({"_site": norm("site"), "firm": firm}).join(
        used.select("_site").distinct(), "_site", "left_semi")
    votes = at.groupBy("_site", "firm").agg(F.count(F.lit(1)).alias("n"), F.min("load_seq").alias("seq"))
    major = votes.groupBy("_site").agg(
        F.sum("n").alias("n_staff"),
        F.max_by("firm", F.when(F.col("firm").isNotNull(), F.struct("n", -F.col("seq")))).alias("company"))
    words = F.filter(F.split(fold("site"), "[^A-Z0-9]+"), lambda w: w != "")
    short = F.create_map(*[F.lit(x) for kv in V.CODE_SHORT.items() for x in kv])
    kept = F.transform(F.filter(words, lambda w: ~w.isin(*V.CODE_FILLERS)),
                       lambda w: F.coalesce(F.element_at(short, w), w))
    picked = F.when(F.size(kept) > 0, F.slice(kept, 1, 4)).when(
        F.size(words) > 0, F.slice(words, 1, 1)).otherwise(F.array(F.lit(V.CODE_FALLBACK)))
    code = F.regexp_replace(F.left(F.array_join(picked, "-"), F.lit(24)), "^-+|-+$", "")
    out = used.withColumn("base", code).join(major, "_site", "left")
    taken = keys.select(F.col("code").alias("base")).distinct().withColumn("taken", F.lit(1))
    w = Window.partitionBy("base").orderBy(F.desc("amount"), "site")
    out = out.join(taken, "base", "left").withColumn(
        "_n", F.row_number().over(w) + F.coalesce("taken", F.lit(0)))
    out = out.withColumn("code", F.when(F.col("_n") == 1, F.col("base")).otherwise(
        F.concat(F.left("base", F.lit(21)), F.lit("-"), F.col("_n"))))
    # A shortened code may meet another site's or the map's: then the site's own mark tells them apart.
    met = taken.select(F.col("base").alias("code"), F.lit(1).alias("in_map"))
    out = out.join(met, "code", "left").withColumn(
        "_same", F.row_number().over(Window.partitionBy("code").orderBy("_n", "site")) + F.coalesce("in_map", F.lit(0)))
    mark = F.concat(F.left("code", F.lit(21)), F.lit("-"), F.hex(F.xxhash64("site")))
    return out.select(
        "site", F.when(F.col("_same") == 1, F.col("code")).otherwise(mark).alias("code"),
        F.coalesce("company", F.lit("")).alias("company"), F.coalesce("n_staff", F.lit(0)).alias("n_staff"),
        "n_lines", "amount", "currency").orderBy(F.desc("amount"), "site")


def review_queue(lines: DataFrame) -> DataFrame:
    """What a person has to look at, UNMATCHED first, registers last."""
    register = F.coalesce("source_type", F.lit("")).isin(*V.REGISTER_TYPES, *V.DETAIL_TYPES)
    return lines.filter(F.col("decision") != V.AUTO).orderBy(
        register, F.when(F.col("decision") == V.UNMATCHED, 0).otherwise(1), "source_seq", "row_no")


def top_centers(centers: DataFrame, k: int = 10) -> DataFrame:
    """The k centres with the largest amounts."""
    return centers.orderBy(F.desc("amount"), "cost_center", "currency").limit(k)


def cover_counts(lines: DataFrame) -> DataFrame:
    """Expense and register lines and their decisions, one row."""
    register = F.coalesce("source_type", F.lit("")).isin(*V.REGISTER_TYPES, *V.DETAIL_TYPES)
    d = F.col("decision")
    return lines.agg(
        F.count_if(~register).alias("n_expense"), F.count_if(register).alias("n_register"),
        F.count_if(~register & (d == V.AUTO)).alias("n_auto"),
        F.count_if(~register & (d == V.REVIEW)).alias("n_review"),
        F.count_if(~register & (d == V.UNMATCHED)).alias("n_unmatched"),
        F.count_if(register & (d != V.AUTO)).alias("n_register_waiting"))


def center_table(lines: DataFrame) -> DataFrame:
    """Plain centre by currency table."""
    return lines.groupBy(
        F.coalesce(F.nullif("cost_center", F.lit("")), F.lit("(none)")).alias("cost_center"),
        F.coalesce(F.nullif("currency", F.lit("")), F.lit("-")).alias("currency")).agg(
        F.count(F.lit(1)).alias("n_lines"), cents(F.sum(F.coalesce("amount", F.lit(0)))).alias("amount"))
