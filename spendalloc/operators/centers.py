"""Cost centre of a line, warnings and decision."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import is_entity, name_norm, site_key
from .asof import as_of, fallback_secondary, line_salt, spread_null


def map_keys(cmap: DataFrame, synonyms=None) -> DataFrame:
    """Lookup key to map row. Sites win over codes and names, these over synonyms."""
    row = F.struct(F.col("site").alias("map_site"), "code", "name", "company", "active")
    own = cmap.select(F.explode(F.array(
        F.struct(site_key("site").alias("key"), F.lit(1).alias("p"), F.lit(0).alias("o")),
        F.struct(site_key("code").alias("key"), F.lit(2).alias("p"), F.lit(1).alias("o")),
        F.struct(site_key("name").alias("key"), F.lit(2).alias("p"), F.lit(2).alias("o")))).alias("k"),
        "load_seq", row.alias("row"))
    keyed = own.select("k.*", "load_seq", "row").filter("key <> ''").groupBy("key").agg(
        F.min_by("row", F.struct("p", "load_seq", "o")).alias("row"), F.min("p").alias("p"))
    table = V.SITE_SYNONYMS if synonyms is None else synonyms
    if not table:
        return keyed.select("key", "row.*")
    pairs = cmap.sparkSession.createDataFrame(list(table.items()), "spelling string, target string")
    extra = pairs.select(site_key("spelling").alias("key"), site_key("target").alias("target")).join(
        keyed.select(F.col("key").alias("target"), "row"), "target").select(
        "key", "row", F.lit(3).alias("p"))
    return keyed.select("key", "row", "p").unionByName(extra).groupBy("key").agg(
        F.min_by("row", "p").alias("row")).select("key", "row.*")


def resolve_center(df: DataFrame, keys: DataFrame, site: str = "site", prefix: str = "") -> DataFrame:
    """Centre of a site text; an unmapped site stays as raw text with in_map false.

    The map is read with its true size, so the planner broadcasts it while it
    is small and shuffles when it is not."""
    right = keys.select(
        F.col("key").alias("_mk"), F.col("code").alias("_code"), F.col("name").alias("_name"),
        F.col("company").alias("_company"), F.col("active").alias("_active"), F.col("map_site").alias("_map_site"))
    key = spread_null(F.nullif(site_key(site), F.lit("")), *line_salt(df))
    j = df.withColumn("_k", key).join(right, F.col("_k") == F.col("_mk"), "left")
    text = F.nullif(F.trim(F.col(site)), F.lit(""))
    hit = F.col("_mk").isNotNull()
    return j.select(
        *df.columns,
        F.when(hit, F.col("_code")).otherwise(text).alias(f"{prefix}cost_center"),
        F.when(hit, F.col("_name")).otherwise(text).alias(f"{prefix}cost_center_name"),
        (hit & text.isNotNull()).alias(f"{prefix}in_map"),
        F.col("_company").alias(f"{prefix}map_company"),
        F.when(hit, ~F.col("_active")).otherwise(F.lit(False)).alias(f"{prefix}inactive"),
        F.col("_map_site").alias(f"{prefix}map_site"))


def missing_sites(sites: DataFrame, keys: DataFrame, site: str = "site") -> DataFrame:
    """Distinct site texts that the map does not know."""
    s = sites.select(F.trim(F.col(site)).alias("site")).filter("site <> ''").distinct()
    return s.withColumn("key", site_key("site")).join(keys, "key", "left_anti").select("site")


def decide(confidence, warnings, center, hi: float = V.AUTO_MIN, lo: float = V.REVIEW_MIN) -> Column:
    """UNMATCHED without centre or confidence; AUTO only without warnings."""
    conf, warn, cc = F.col(confidence), F.col(warnings), F.col(center)
    none = (conf < lo) | cc.isNull() | (cc == "")
    return F.when(none, V.UNMATCHED).when((conf >= hi) & (F.size(warn) == 0), V.AUTO).otherwise(V.REVIEW)


def decide_match() -> Column:
    """Decision from the match alone, before the centre is known."""
    listed = F.size(F.coalesce("candidates", F.array().cast("array<string>"))) > 0
    return (
        F.when(F.col("method") == "none", V.UNMATCHED)
        .when(F.col("staff_id").isNull() & (F.col("method") != "external"),
              F.when(listed | (F.col("method") == "extra"), V.REVIEW).otherwise(V.UNMATCHED))
        .when(F.col("confidence") >= V.AUTO_MIN, V.AUTO)
        .otherwise(V.REVIEW)
    )


def _month(c) -> Column:
    return F.date_format(c, "yyyy-MM")


def _day(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def period_warnings() -> Column:
    """What the relation of the roster month to the document date means (null if nothing)."""
    rel = F.col("relation")
    left = F.col("status_norm") == "Cikis"
    gap = F.concat(F.lit("PERIOD: no roster row in "), _month("doc_date"), F.lit("; "))
    used = F.concat(F.lit("; "), _month("period"), F.lit(" used"))
    moved = F.when(
        F.col("moved"), F.concat(F.lit(". ATTENTION: secondary roster shows "), F.col("sec_site"))).otherwise("")
    return (
        F.when(rel == "secondary", F.concat(
            F.lit("PERIOD: not in the main roster; secondary roster row used, month not verified ("),
            F.coalesce("company2", "company", F.lit("?")), F.lit(")")))
        .when(rel == "undated", F.lit("PERIOD: no document date; latest roster row used"))
        .when((rel == "before_first") & (F.col("hire_date") <= F.col("doc_date")), F.concat(
            F.lit("PERIOD: roster file starts after the date, staff since "), _day("hire_date"), used))
        .when(rel == "before_first", F.concat(
            F.lit("PERIOD: date before the first roster row, not hired yet"), used))
        .when(rel == "roster_stale", F.concat(
            F.lit("PERIOD: roster file ends before "), _month("doc_date"), used, moved))
        .when((rel == "earlier") & left, F.concat(gap, F.lit("has left"), used, moved))
        .when(rel == "earlier", F.concat(gap, F.lit("record cut without a leave"), used, moved))
    )


def leaver_warning() -> Column:
    """P5: left before the document date."""
    gone = (F.col("status_norm") == "Cikis") & (F.col("exit_date") < F.col("doc_date"))
    return F.when(gone, F.concat(F.lit("LEFT: left on "), _day("exit_date")))


def compare_label(entity_check: bool = False) -> tuple[Column, Column]:
    """(class, warning) of the feed's label against the resolved centre.

    Classes: none, agrees, differs, entity, unknown. An entity name is not a
    project and raises nothing unless the legal-entity check is on."""
    label = F.nullif(F.trim(F.coalesce("site_label", F.lit(""))), F.lit(""))
    has = label.isNotNull() & F.col("cost_center").isNotNull()
    same_text = site_key("site_label").isin(site_key("site"), site_key("cost_center"))
    kind = (
        F.when(~has, "none")
        .when(is_entity("site_label"), "entity")
        .when(~F.col("label_in_map"), F.when(same_text, "agrees").otherwise("unknown"))
        .when(F.col("label_cost_center") == F.col("cost_center"), "agrees")
        .otherwise("differs")
    )
    entity = F.lit(None).cast("string")
    if entity_check:
        entity = F.when(
            (kind == "entity") & (F.coalesce("company2", F.lit("")) != "")
            & (site_key("site_label") != site_key("company2")),
            F.concat(F.lit("ENTITY: feed says "), label, F.lit(", roster says "), F.col("company2")))
    warning = (
        F.when(kind == "differs", F.concat(
            F.lit("PROJECT: feed says "), label, F.lit(", roster says "), F.col("cost_center")))
        .when(kind == "unknown", F.concat(F.lit("LABEL: not in the map: "), label))
        .otherwise(entity)
    )
    return kind, warning


def namesake_warning(df: DataFrame, secondary: DataFrame, keys: DataFrame) -> DataFrame:
    """P10: another person of that name in another project of the secondary roster.

    Works on distinct (name, id, centre), so a frequent person is compared once."""
    use = df.filter(F.col("staff_id").isNotNull() & F.col("method").isin(*V.NAME_METHODS))
    probe = use.select("staff_id", "matched_name", "site", "cost_center", "in_map").distinct().withColumn(
        "_nm", name_norm("matched_name")).filter("_nm <> ''")
    sec = resolve_center(
        secondary.filter("norm <> '' and trim(site) <> ''").select(
            F.col("norm").alias("_nm"), F.col("staff_id").alias("_other"), F.col("site").alias("_site"),
            F.coalesce("company2", "company", F.lit("?")).alias("_firm"), "load_seq"),
        keys, "_site", "_o_")
    same = F.when(F.col("in_map") & F.col("_o_in_map"), F.col("cost_center") == F.col("_o_cost_center")) \
        .otherwise(site_key("site") == site_key("_site"))
    hit = probe.join(sec, "_nm").filter((F.col("_other") != F.col("staff_id")) & ~F.coalesce(same, F.lit(False)))
    notes = hit.groupBy("staff_id", "matched_name", "site").agg(
        F.min_by(F.concat("_site", F.lit(" ("), "_firm", F.lit(")")), F.struct("load_seq", "_other")).alias("_first"),
        F.count_distinct("_other").alias("_n"))
    notes = notes.select(
        F.col("staff_id").alias("_i"), F.col("matched_name").alias("_m"), F.col("site").alias("_s"),
        F.concat(F.lit("NAMESAKE: also in the secondary roster at "), F.col("_first"),
                 F.when(F.col("_n") > 1, F.concat(F.lit(" and "), F.col("_n") - 1, F.lit(" more"))).otherwise("")
                 ).alias("namesake"))
    key = spread_null(F.when(F.col("method").isin(*V.NAME_METHODS), F.col("staff_id")), "doc_date", "amount")
    j = df.withColumn("_key", key).join(
        notes, (F.col("_key") == F.col("_i")) & F.col("matched_name").eqNullSafe(F.col("_m"))
        & F.col("site").eqNullSafe(F.col("_s")), "left")
    return j.select(*df.columns, "namesake")


def ledger_sites(ledgers) -> DataFrame:
    """Centre known from the ledgers, by name or national id."""
    ext, extra = ledgers.get("external"), ledgers.get("extra")
    parts = []
    if ext is not None and "cost_center" in ext.columns:
        parts.append(ext.select(F.col("name_norm").alias("key"), F.col("cost_center").alias("lsite"),
                                F.lit(1).alias("p"), "load_seq"))
    if extra is not None and "site" in extra.columns:
        parts.append(extra.select("key", F.col("site").alias("lsite"), F.lit(2).alias("p"), "load_seq"))
    if not parts:
        return None
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    table = table.filter("key <> '' and trim(lsite) <> ''")
    return table.groupBy("key").agg(F.min_by("lsite", F.struct("p", "load_seq")).alias("lsite"))


def resolve_lines(lines: DataFrame, snap: DataFrame, cmap: DataFrame, secondary: DataFrame = None,
                  ledgers=None, hi: float = V.AUTO_MIN, lo: float = V.REVIEW_MIN,
                  entity_check: bool = False, synonyms=None) -> DataFrame:
    """Section 2.6 as one flow over matched lines: roster month, centre, warnings, decision."""
    from ..functions.text import status_norm

    ledgers = ledgers or {}
    snap = snap.select("staff_id", "period", "site", "company", "company2", "status", "category",
                       "hire_date", "exit_date", "load_seq").withColumnRenamed("category", "staff_category")
    df = as_of(lines, snap.withColumn("status_norm", status_norm("staff_category"))).drop("load_seq")
    if secondary is not None:
        df = fallback_secondary(df, secondary)
    else:
        df = df.withColumns({c: F.lit(None).cast("string") for c in ("sec_site", "sec_company", "sec_company2")})
    keys = map_keys(cmap, synonyms)
    # No staff id: the ledgers' centre, else the feed's own label.
    known = ledger_sites(ledgers)
    df = df.withColumn("lsite", F.lit(None).cast("string"))
    if known is not None:
        no_id = F.col("staff_id").isNull()
        for n, key in enumerate((name_norm("matched_name"), F.col("norm"), F.col("nid"))):
            k = spread_null(F.when(no_id, F.nullif(key, F.lit(""))), "doc_date", "amount")
            right = known.select(F.col("key").alias("_lk"), F.col("lsite").alias("_ls"))
            df = df.withColumn("_k", k).join(right, F.col("_k") == F.col("_lk"), "left").withColumn(
                "lsite", F.coalesce("lsite", "_ls")).drop("_k", "_lk", "_ls")
    label = F.nullif(F.trim(F.coalesce("site_label", F.lit(""))), F.lit(""))
    has_id = F.col("staff_id").isNotNull()
    df = df.withColumns({
        "origin": F.when(has_id & F.col("relation").isNotNull(), "roster")
                   .when(has_id, "none").when(F.col("lsite").isNotNull(), "ledger")
                   .when(label.isNotNull(), "feed").otherwise("none"),
        "site_text": F.when(has_id, F.col("site")).otherwise(F.coalesce("lsite", label))})
    df = resolve_center(df, keys, "site_text")
    entity_only = ~has_id & ~F.col("in_map") & is_entity("site_text")
    df = df.withColumns({
        "entity_only": entity_only,
        "cost_center": F.when(~entity_only, F.col("cost_center")),
        "cost_center_name": F.when(~entity_only, F.col("cost_center_name"))})
    df = resolve_center(df, keys, "site_label", "label_")
    df = resolve_center(df, keys, "sec_site", "sec_")
    same = F.when(F.col("in_map") & F.col("sec_in_map"), F.col("cost_center") == F.col("sec_cost_center")) \
        .otherwise(site_key("sec_site") == site_key("site"))
    df = df.withColumn("moved", (F.coalesce("sec_site", F.lit("")) != "") & ~F.coalesce(same, F.lit(False)))
    if secondary is not None:
        df = namesake_warning(df, secondary, keys)
    else:
        df = df.withColumn("namesake", F.lit(None).cast("string"))
    kind, label_note = compare_label(entity_check)
    reader = F.col("reader_warning") if "reader_warning" in lines.columns else F.lit(None).cast("string")
    found = has_id & F.col("relation").isNotNull()
    w = [
        F.when(F.coalesce(reader, F.lit("")) != "", F.concat(F.lit("READER: "), reader)),
        F.when(has_id & F.col("relation").isNull(), F.lit("ROSTER: staff id not found")),
        F.when(found, period_warnings()),
        F.when(found, leaver_warning()),
        F.when(found & F.col("cost_center").isNull(), F.lit("MAP: roster row has no site")),
        F.when(F.col("inactive"), F.concat(F.lit("MAP: inactive centre "), F.col("cost_center"))),
        F.when(F.col("cost_center").isNotNull() & ~F.col("in_map"),
               F.concat(F.lit("MAP: not in the map: "), F.col("site_text"))),
        F.when(entity_only, F.concat(F.lit("MAP: a legal entity, not a project: "), F.col("site_text"))),
        F.when(found, label_note),
        F.when(found, F.col("namesake")),
        F.when(~has_id & F.col("cost_center").isNull(), F.lit("PERSON: no staff id and no usable site")),
        F.when(~has_id & F.col("cost_center").isNotNull(), F.concat(
            F.lit("PERSON: not in the roster, centre proposed by "), F.col("origin"))),
    ]
    df = df.withColumns({
        "warnings": F.filter(F.array(*w), lambda x: x.isNotNull()),
        "label_class": F.when(found, kind).when(label.isNull(), "none").when(
            is_entity("site_label"), "entity").otherwise("agrees")})
    df = df.withColumns({
        "company": F.coalesce("map_company", F.when(found, F.col("company2"))),
        "relation": F.coalesce("relation", F.lit("none")),
        "in_map": F.when(found, F.col("in_map")).otherwise(F.lit(True)),
        "decision": decide("confidence", "warnings", "cost_center", hi, lo)})
    keep = [*lines.columns, "period", "site", "cost_center", "cost_center_name", "in_map", "company",
            "company2", "status", "status_norm", "exit_date", "relation", "origin", "label_class",
            "decision", "warnings"]
    return df.select(*keep)
