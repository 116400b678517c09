"""Splitting money between centres and companies (A1-A10)."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import column_key, company_of, is_entity, site_key
from ..functions.values import CENTS, cents
from .asof import spread_null
from .common import block_row_number, cut_lineage, top_per_group

PART = "decimal(28,10)"
LINE = ["source_seq", "row_no"]
KEY = ["feed", "category", "cost_center", "company", "currency", "share_note"]


# --- A1 ----------------------------------------------------------------------

def line_kind() -> Column:
    """A1: register, document, amountless or expense."""
    t = F.coalesce("source_type", F.lit(""))
    return (
        F.when(t.isin(*V.DOCUMENT_TYPES), "document")
        .when(t.isin(*V.REGISTER_TYPES, *V.DETAIL_TYPES), "register")
        .when(F.col("amount").isNull(), "amountless")
        .otherwise("expense")
    )


def eligible(lines: DataFrame) -> DataFrame:
    """A1: lines that are allocated."""
    return lines.filter(line_kind() == "expense")


def left_out(lines: DataFrame) -> DataFrame:
    """A1: how many lines of each kind stay out or go in."""
    return lines.groupBy(line_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n_lines"))


# --- A2-A5 -------------------------------------------------------------------

def base_parts(lines: DataFrame) -> DataFrame:
    """A5: centre and company of a whole line; UNMATCHED money has neither."""
    lost = (F.col("decision") == V.UNMATCHED) | (F.coalesce("cost_center", F.lit("")) == "")
    company = F.coalesce("company", "company2")
    return lines.withColumns({
        "cost_center": F.when(lost, V.UNALLOCATED).otherwise(F.col("cost_center")),
        "cost_center_name": F.when(~lost, F.col("cost_center_name")),
        "company": F.when(~lost, company),
        "in_map": F.coalesce("in_map", F.lit(True)) & ~lost,
    })


def _share_plans(noted: DataFrame, keys: DataFrame) -> DataFrame:
    """What each distinct share list means: its valid items, their sum and the warning.

    noted has _skey, _shares. Labels are read and looked up here, once per
    distinct list instead of once per line."""
    # Distinct first, so that nothing but a handful of lists is ever sorted.
    e = noted.distinct().groupBy("_skey").agg(F.first("_shares").alias("_shares")).select(
        "_skey", F.posexplode("_shares").alias("_pos", "_s"))
    e = e.select("_skey", "_pos", F.trim("_s.label").alias("_label"), F.col("_s.num").alias("_num"), F.col("_s.den").alias("_den"))
    e = e.withColumns({"_lkey": site_key("_label"), "_canon": company_of("_label"), "_entity": is_entity("_label")})
    right = keys.select(F.col("key").alias("_lkey"), F.col("code").alias("_code"), F.col("name").alias("_cname"),
                        F.col("company").alias("_ccomp"), F.lit(True).alias("_hit"))
    e = e.join(right, "_lkey", "left")
    project = F.coalesce("_hit", F.lit(False))
    valid = F.coalesce((F.col("_num") > 0) & (project | F.col("_canon").isNotNull() | F.col("_entity")), F.lit(False))
    item = F.struct(
        "_pos", valid.alias("v"), project.alias("project"), F.col("_code").alias("code"), F.col("_cname").alias("name"),
        F.when(project, F.col("_ccomp")).otherwise(F.coalesce("_canon", "_label")).alias("firm"),
        F.concat("_label", F.lit(" "), "_num", F.lit("/"), "_den").alias("note"),
        F.col("_num").alias("num"), F.col("_den").alias("den"), F.col("_label").alias("label"))
    # A list has a handful of items.
    p = e.groupBy("_skey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    good, bad = F.filter("items", lambda s: s["v"]), F.filter("items", lambda s: ~s["v"])
    p = p.withColumns({"_good": good, "_bad": bad})
    # Exact comparison of the sum of fractions with one, on a common denominator.
    total = F.aggregate("_good", F.lit(0).cast("bigint"), lambda a, s: a + F.round(COMMON * s["num"] / s["den"]).cast("bigint"))
    notes = F.array_join(F.transform("_good", lambda s: s["note"]), ", ")
    over = (F.size("_good") > 0) & (total > COMMON)
    warning = F.when(over, F.concat(F.lit("SHARE: shares exceed one, not applied: "), notes)).when(
        F.size("_bad") > 0, F.concat(F.lit("SHARE: neither entity nor project: "),
                                     F.array_join(F.transform("_bad", lambda s: s["label"]), ", ")))
    return p.select(
        "_skey", F.when(over, F.lit("over")).when(F.size("_good") == 0, "none").when(total < COMMON, "rest").otherwise("all").alias("_kind"),
        "_good", F.concat(F.lit("SHARE ERROR: "), notes).alias("_error"),
        F.concat(F.lit("(rest "), F.format_number(1 - total / COMMON, 2), F.lit(")")).alias("_rest"), warning.alias("_warning"))


COMMON = 27720  # least common multiple of the denominators 1 to 12


def explode_shares(lines: DataFrame, keys: DataFrame, inherited: bool = True) -> DataFrame:
    """A2-A4: one row per line and part, with `part` money and a share note.

    A project label moves centre and company, an entity label only the
    company, any other label is no share. Parts below one leave the rest with
    the line's own company; parts above one are not applied. Lines are not
    regrouped: each joins the plan of its share list and is then unfolded. The
    plans are written, so that a few of them are broadcast by their size instead
    of bringing all lines of a common list into one task."""
    none = F.array().cast(lines.schema["shares"].dataType)
    own = F.coalesce("shares", none)
    if inherited and "inherited_shares" in lines.columns:
        own = F.when(F.size(own) > 0, own).otherwise(F.coalesce("inherited_shares", none))
    df = base_parts(lines)
    cols = df.columns
    df = df.withColumn("_shares", F.when(F.col("cost_center") != V.UNALLOCATED, own).otherwise(none))
    text = F.array_join(F.transform("_shares", lambda s: F.concat(
        F.coalesce(s["label"], F.lit("")), F.lit("\u0001"), F.coalesce(s["num"], F.lit(0)), F.lit("/"),
        F.coalesce(s["den"], F.lit(0)))), "\u0002")
    df = df.withColumn("_skey", F.when(F.size("_shares") > 0, text))
    plans = cut_lineage(_share_plans(df.filter("_skey is not null").select("_skey", "_shares"), keys))
    # Lines without shares carry spread keys that match nothing.
    j = df.withColumn("_jkey", spread_null("_skey", *LINE)).drop("_skey", "_shares").join(
        plans.withColumnRenamed("_skey", "_jkey"), "_jkey", "left")

    def part(c, n, f, m, t, p):
        return F.struct(c.alias("c"), n.alias("n"), f.alias("f"), m.alias("m"), t.cast("string").alias("t"), p.cast(PART).alias("p"))

    home = (F.col("cost_center"), F.col("cost_center_name"), F.col("company"), F.col("in_map"))
    money = lambda s: (F.col("amount") * s["num"] / s["den"]).cast(PART)
    split = F.transform("_good", lambda s: part(
        F.when(s["project"], s["code"]).otherwise(home[0]), F.when(s["project"], s["name"]).otherwise(home[1]),
        F.coalesce(s["firm"], home[2]), s["project"] | home[3], s["note"], money(s)))
    spent = F.aggregate("_good", F.lit(0).cast(PART), lambda a, s: (a + money(s)).cast(PART))
    left = part(*home, F.col("_rest"), F.col("amount") - spent)
    parts = (
        F.when(F.col("_kind") == "over", F.array(part(*home, F.col("_error"), F.col("amount"))))
        .when(F.col("_kind") == "rest", F.concat(split, F.array(left)))
        .when(F.col("_kind") == "all", split)
        .otherwise(F.array(part(*home, F.lit(None), F.col("amount"))))
    )
    keep = [c for c in cols if c not in ("cost_center", "cost_center_name", "company", "in_map")]
    x = j.select(*keep, F.explode(parts).alias("_p"), F.col("_warning").alias("share_warning"))
    return x.select(
        *keep, F.col("_p.c").alias("cost_center"), F.col("_p.n").alias("cost_center_name"), F.col("_p.f").alias("company"),
        F.col("_p.m").alias("in_map"), F.col("_p.p").alias("part"), F.col("_p.t").alias("share_note"), "share_warning")


# --- A6-A8 -------------------------------------------------------------------

def company_key(label) -> Column:
    """One name per company, however invoices and lists of persons spell it; null for a blank one."""
    key = column_key(label)
    known = F.create_map(*[F.lit(x) for pair in V.POOL_COMPANY.items() for x in pair])
    return F.coalesce(known[key], F.nullif(F.upper(key), F.lit("")))


def pool_totals(detail: DataFrame) -> DataFrame:
    """Declared pool per company, all its spellings together: detail has company, amount.

    Written, so that a few pools go to the persons by their size; dealt out by
    pool, all persons of one would be read by one task."""
    d = detail.withColumn("company", company_key("company")).filter("company is not null and amount is not null")
    return cut_lineage(d.groupBy("company").agg(F.sum("amount").cast("decimal(28,6)").alias("pool")))


def bridge_pools(persons: DataFrame, pools: DataFrame) -> DataFrame:
    """Persons whose company has no pool get the only pool that has no persons.

    persons has company in any spelling, pools comes from `pool_totals`; the
    result adds pool_company. Without a company, or where several pools or none
    are without persons, it stays null."""
    p = persons.withColumn("_company", company_key("company"))
    have = cut_lineage(p.select("_company").distinct())
    empty = pools.select("company").join(have, F.col("company") == F.col("_company"), "left_anti")
    only = empty.agg(F.count(F.lit(1)).alias("n"), F.first("company").alias("c"))
    lone = only.select(F.when(F.col("n") == 1, F.col("c")).alias("c")).scalar()
    known = pools.select(F.col("company").alias("_company"), F.lit(True).alias("_known"))
    j = p.join(known, "_company", "left")
    return j.withColumn("pool_company", F.when(F.col("_known"), F.col("_company")).when(
        F.col("_company").isNotNull(), lone)).drop("_known", "_company")


def split_pool(persons: DataFrame, pools: DataFrame, order=("source_seq", "row_no")) -> DataFrame:
    """Equal shares to the cent; surplus cents go to the first persons.

    A pool may hold most of the rows: positions are counted over row blocks,
    and the size of each pool is written and goes to the rows by its own size."""
    p = cut_lineage(persons.filter(F.col("pool_company").isNotNull()))
    sized = p.groupBy("pool_company").agg(F.count(F.lit(1)).alias("n"))
    sized = cut_lineage(pools.select(F.col("company").alias("pool_company"), F.round(F.col("pool") * 100).cast(
        "bigint").alias("pool_cents")).join(sized, "pool_company"))
    ranked = block_row_number(p, ["pool_company"], list(order), "pos")
    j = ranked.join(sized, "pool_company")
    size, extra = F.expr("pool_cents div n"), F.expr("pmod(pool_cents, n)")
    # Floor division: a negative pool rounds down like a positive one.
    size = F.when((F.col("pool_cents") < 0) & (extra != 0), size - 1).otherwise(size)
    share = size + F.when(F.col("pos") <= extra, 1).otherwise(0)
    return j.withColumn("amount", (share.cast("decimal(20,0)") / 100).cast(CENTS)).drop("pool_cents", "n", "pos")


# --- A9, A10 -----------------------------------------------------------------

def person_key() -> Column:
    return F.coalesce(F.nullif("staff_id", F.lit("")), F.nullif("pnorm", F.lit("")))


def allocation_parts(parts: DataFrame) -> DataFrame:
    """Parts under the six key columns of an allocation row (empty text for null keys)."""
    label = F.coalesce(F.nullif(F.trim("site_label"), F.lit("")), F.col("inherited_label")) \
        if "inherited_label" in parts.columns else F.nullif(F.trim("site_label"), F.lit(""))
    doc = F.coalesce(F.nullif("doc_no", F.lit("")), F.col("invoice_no")) if "doc_no" in parts.columns \
        else F.lit(None).cast("string")
    return parts.select(
        "feed", F.coalesce(F.nullif("category", F.lit("")), F.lit(V.DEFAULT_CATEGORY)).alias("category"),
        "cost_center", F.coalesce("company", F.lit("")).alias("company"), F.col("ccy").alias("currency"),
        F.coalesce("share_note", F.lit("")).alias("share_note"), "cost_center_name", "in_map", "part",
        "decision", "doc_date", person_key().alias("person"), label.alias("label"),
        F.nullif(doc, F.lit("")).alias("doc"), *LINE)


def _first_centers(p: DataFrame) -> DataFrame:
    """Centre name and map flag of the first part of each allocation row, under renamed keys.

    Numbers are reduced per name before names are compared: a text in an
    aggregate's buffer would have all parts sorted."""
    own = ["cost_center_name", "in_map"]
    least = p.groupBy(*KEY, *own, LINE[0]).agg(
        F.min(LINE[1]).alias(LINE[1]), F.max(F.col(LINE[1]).isNull()).alias("_none"))
    at = F.struct(LINE[0], F.when(~F.col("_none"), F.col(LINE[1])))
    first = least.groupBy(*KEY).agg(F.min_by(F.struct(*own), at).alias("_f"))
    return first.select(*[F.col(k).alias(f"_{k}") for k in KEY], "_f.*")


def allocate(parts: DataFrame, details: bool = True, centers: bool = True) -> DataFrame:
    """Allocation rows. Money is summed exactly and rounded once.

    Labels and document numbers are reduced to distinct values first; of the
    documents only the first five per row are carried, plus a count. Without
    `centers`, centre name and map flag of a row are left out."""
    p = allocation_parts(parts)
    rows = p.groupBy(*KEY).agg(
        cents(F.sum("part")).alias("amount"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_distinct("person").alias("n_persons"),
        F.count_if(F.col("decision") == V.AUTO).alias("n_auto"),
        F.count_if(F.col("decision") == V.REVIEW).alias("n_review"),
        F.count_if(~F.col("decision").isin(V.AUTO, V.REVIEW)).alias("n_unmatched"),
        F.min("doc_date").alias("first_date"), F.max("doc_date").alias("last_date"))
    if centers:
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY])
        rows = rows.join(_first_centers(p), same).drop(*[f"_{k}" for k in KEY])
    if not details:
        return rows
    labels = p.filter("label is not null").select(*KEY, "label").distinct().groupBy(*KEY).agg(
        F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("labels"))
    docs = p.filter("doc is not null").groupBy(*KEY, "doc").agg(F.min(F.struct(*LINE)).alias("at"))
    n_docs = docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"))
    first = top_per_group(docs, KEY, ["at"], 5).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "doc"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["doc"]), ", ")
    more = F.when(F.col("n_docs") > 5, F.concat(F.lit(" (+"), F.col("n_docs") - 5, F.lit(")"))).otherwise("")
    docs = first.join(n_docs, KEY).select(*KEY, F.concat(text, more).alias("doc_numbers"))
    return rows.join(labels, KEY, "left").join(docs, KEY, "left")


def settle_remainder(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """A10: the rounding rest of a feed and currency goes to its largest row.

    targets has feed, currency, target. Gaps above 0.50 are no rounding and
    stay open. The rows meet themselves, so they are written once instead of
    being allocated twice."""
    group = ["feed", "currency"]
    rows = cut_lineage(rows)
    have = rows.groupBy(*group).agg(
        F.sum("amount").alias("have"),
        F.max_by(F.struct(*[c for c in KEY if c not in group]),
                 F.struct(F.abs("amount"), *[c for c in KEY if c not in group])).alias("big"))
    gap = have.join(targets, group).withColumn("gap", (cents("target") - F.col("have")).cast(CENTS))
    gap = gap.filter((F.abs("gap") >= 0.005) & (F.abs("gap") <= 0.50)).select(*group, "big.*", "gap")
    return rows.join(gap, KEY, "left").withColumn(
        "amount", (F.col("amount") + F.coalesce("gap", F.lit(0))).cast(CENTS)).drop("gap")
