"""Long cells, headers and columns of unknown feeds.

cells: source_seq INT, file STRING, sheet STRING, row INT, col INT, value STRING,
one row per non-empty cell; row and col start at 0.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import category_hint, column_key, fold, name_norm
from ..functions.values import cell_text, id_like, national_id, parse_amount, parse_date, staff_id
from ..operators.common import cut_lineage

SHEET = ["source_seq", "file", "sheet"]
ROW = [*SHEET, "row"]


def to_cells(grid: DataFrame) -> DataFrame:
    """Rows with an array of cells to long cells; blank marks are dropped."""
    c = grid.select(*ROW, F.posexplode("cells").alias("col", "value"))
    return c.withColumn("value", cell_text("value")).filter(F.col("value").isNotNull())


def _is_text(value) -> Column:
    v = F.col(value)
    return parse_amount(v)["value"].isNull() & parse_date(v).isNull()


def header_rows(cells: DataFrame, wanted=()) -> DataFrame:
    """H1: header row of each sheet among the first 15 rows.

    The first row with a wanted key, else the best score of text cells minus
    half of the data cells, with at least two text cells."""
    top = cells.filter(F.col("row") < V.HEADER_ROWS).withColumn("text", _is_text("value"))
    keys = [k for k in wanted]
    hit = column_key("value").isin(*keys) if keys else F.lit(False)
    rows = top.groupBy(*ROW).agg(
        F.count_if("text").alias("n_text"), F.count_if(~F.col("text")).alias("n_data"),
        F.bool_or(hit).alias("hit"))
    score = F.col("n_text") - 0.5 * F.col("n_data")
    rows = rows.withColumn("score", score)
    good = (F.col("n_text") >= 2) & (F.col("score") > 0)
    best = rows.groupBy(*SHEET).agg(
        F.min(F.when(F.col("hit"), F.col("row"))).alias("wanted_row"),
        F.max_by("row", F.when(good, F.struct("score", -F.col("row")))).alias("best_row"))
    return best.select(*SHEET, F.coalesce("wanted_row", "best_row").alias("header_row")).filter(
        F.col("header_row").isNotNull())


def column_keys(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """H2: normalised header keys; of equal keys the first column wins."""
    h = cells.join(headers, SHEET).filter(F.col("row") == F.col("header_row")).withColumn("key", column_key("value"))
    return h.filter("key <> ''").groupBy(*SHEET, "header_row", "key").agg(F.min("col").alias("col"))


def synonym_table(spark, user: DataFrame = None) -> DataFrame:
    """Field synonyms in order of priority; user synonyms come before the built-in ones."""
    rows = [(f, column_key_text(s), 1, i) for f, names in V.FIELD_SYNONYMS.items() for i, s in enumerate(names)]
    base = spark.createDataFrame(rows, "field string, synonym string, tier int, priority int")
    if user is None:
        return base
    mine = user.select("field", column_key("synonym").alias("synonym"), F.lit(0).alias("tier"),
                       F.col("load_seq").cast("int").alias("priority"))
    return mine.filter("synonym <> ''").unionByName(base)


def column_key_text(text: str) -> str:
    """Built-in synonyms are already in key form, except for non-Latin spellings."""
    plain = "".join(V.CYRILLIC_ONE.get(ch.upper(), V.CYRILLIC_LONG.get(ch.upper(), ch)) for ch in text)
    return plain.lower()


def _matches(key, synonym) -> Column:
    """A synonym occurs in a header: long ones anywhere, short ones as a whole word
    with an optional suffix and outside the compounds that number something else."""
    k, s = F.col(key), F.col(synonym)
    banned = F.lit(False)
    for short, words in V.SHORT_EXCLUSIONS.items():
        banned = banned | ((s == short) & k.rlike("|".join(words)))
    word = F.exists(F.split(k, " "), lambda w: w.startswith(s) & F.substring(
        w, F.length(s) + 1, F.length(w)).isin(*V.SHORT_SUFFIXES))
    return F.when(F.length(s) <= V.SHORT_SYNONYM, word & ~banned).otherwise(k.contains(s))


def resolve_columns(headers: DataFrame, synonyms: DataFrame) -> DataFrame:
    """H3: one column per field: an exact synonym first, then a contained one.

    Both sides are short lists of labels: distinct header keys are compared
    with the list of synonyms once, and the outcome is joined back to the sheets."""
    syn = synonyms.agg(F.collect_set(F.struct("field", "synonym", "tier", "priority")).alias("s")).scalar()
    keys = headers.select("key").distinct().select("key", F.explode(syn).alias("s")).select("key", "s.*")
    excluded = F.lit(False)
    for field, words in V.FIELD_EXCLUSIONS.items():
        excluded = excluded | ((F.col("field") == field) & F.col("key").rlike("|".join(words)))
    exact = F.col("key") == F.col("synonym")
    keys = keys.filter(~excluded & (exact | _matches("key", "synonym"))).withColumn(
        "phase", F.when(exact, 0).otherwise(1))
    hits = keys.groupBy("key", "field").agg(F.min(F.struct("phase", "tier", "priority")).alias("rank"))
    found = headers.join(hits, "key")
    out = found.groupBy(*SHEET, "header_row", "field").agg(
        F.min_by(F.struct("col", "key"), F.struct("rank", "col")).alias("c"))
    out = out.select(*SHEET, "header_row", "field", "c.col", "c.key")
    # One column cannot be a person and a site, an id of two kinds, or an amount and its currency.
    owner = out.groupBy(*SHEET, "col").agg(F.collect_set("field").alias("all"))
    has = lambda f: F.array_contains("all", f)
    clash = (
        ((F.col("field") == "site_label") & has("person"))
        | ((F.col("field") == "staff_id") & has("national_id"))
        | ((F.col("field") == "currency") & (has("amount") | has("person"))))
    return out.join(owner, [*SHEET, "col"]).filter(~clash).drop("all")


def validate_id_columns(cells: DataFrame, resolved: DataFrame) -> DataFrame:
    """H4: drop id columns of which under 60 % of the filled values look like ids."""
    ids = resolved.filter("field = 'staff_id'").select(*SHEET, "header_row", "col")
    v = cells.join(ids, [*SHEET, "col"]).filter(F.col("row") > F.col("header_row"))
    bad = v.withColumn("ok", id_like("value")).groupBy(*SHEET, "col").agg(
        (F.avg(F.col("ok").cast("double")) < V.ID_SHARE).alias("bad")).filter("bad")
    return resolved.join(bad.withColumn("field", F.lit("staff_id")).drop("bad"), [*SHEET, "col", "field"], "left_anti")


def drop_pivot_sheets(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """H5: sheets with pivot marks at or above the header row are summaries, not lists."""
    c = cells.join(headers, SHEET).filter(F.col("row") <= F.col("header_row")).withColumn("key", column_key("value"))
    mark = F.col("key").rlike("|".join(V.PIVOT_MARKS)) | ((F.col("row") == F.col("header_row")) & F.col("key").isin(*V.PIVOT_HEADERS))
    return cells.join(c.filter(mark).select(*SHEET).distinct(), SHEET, "left_anti")


def is_total_label(c) -> Column:
    """H6: a generic total or summary label (not a person called TOTAL)."""
    k = column_key(c)
    words = F.split(k, " ")
    tail = (F.size(words) >= 2) & F.get(words, F.lit(0)).isin("toplam", "total") & F.forall(
        F.slice(words, F.lit(2), F.size(words)), lambda w: w.isin(*V.TOTAL_TAILS))
    prefix = F.lit(False)
    for p in V.TOTAL_PREFIXES:
        prefix = prefix | k.startswith(p)
    return k.isin(*V.TOTAL_LABELS) | prefix | tail


def drop_total_rows(lines: DataFrame) -> DataFrame:
    """H6: generic total rows; a line with a national id is always a person."""
    total = is_total_label("person_raw") | is_total_label(F.coalesce("staff_id_raw", F.lit("")))
    return lines.filter(F.col("national_id_raw").isNotNull() | ~F.coalesce(total, F.lit(False)))


def currency_of(c) -> Column:
    """H8: ISO currency named in a text, else null."""
    k = column_key(c)
    code = F.upper(k)
    table = F.create_map(*[F.lit(x) for kv in V.CURRENCY_WORDS.items() for x in kv])
    words = F.filter(F.transform(F.split(k, " "), lambda w: F.element_at(table, w)), lambda x: x.isNotNull())
    raw = F.filter(F.transform(F.split(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), r"[\s()]+"),
                               lambda w: F.element_at(table, w)), lambda x: x.isNotNull())
    return F.when(code.isin("USD", "EUR", "RUB", "TRY", "GBP", "KZT", "CNY"), code).otherwise(
        F.coalesce(F.get(words, F.lit(0)), F.get(raw, F.lit(0))))


def column_report(resolved: DataFrame, headers: DataFrame) -> DataFrame:
    """H9: per sheet which fields were found and which are missing."""
    fields = F.array(*[F.lit(f) for f in V.FIELD_SYNONYMS])
    found = resolved.groupBy(*SHEET).agg(F.array_sort(F.collect_set("field")).alias("found"))
    sheets = headers.select(*SHEET).distinct().join(found, SHEET, "left").withColumn(
        "found", F.coalesce("found", F.array().cast("array<string>")))
    person = F.arrays_overlap("found", F.array(*[F.lit(f) for f in ("person", "staff_id", "national_id")]))
    return sheets.withColumns({"missing": F.array_except(fields, "found"),
                               "usable": F.coalesce(person, F.lit(False))})


def to_lines(cells: DataFrame, headers: DataFrame, resolved: DataFrame) -> DataFrame:
    """Cells below the header to expense lines, one shuffle by row.

    Unresolved columns stay in a map. A missing person's description is built
    from the row's other cells, without ids, dates, phone numbers and personal columns."""
    names = column_names(cells, headers)
    amount_head = resolved.filter("field = 'amount'").select(*SHEET, F.col("key").alias("amount_key"))
    body = cells.join(headers, SHEET).filter(F.col("row") > F.col("header_row"))
    body = body.join(resolved.select(*SHEET, "col", "field"), [*SHEET, "col"], "left")
    body = body.join(names, [*SHEET, "col"], "left")
    get = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    personal = F.col("key").rlike(r"(?:^|\s)(?:" + "|".join(V.PERSONAL_HEADER) + r")(?:\s|$)")
    phone = (F.length(F.regexp_replace("value", r"\D", "")) >= 10) & F.col("value").rlike(r"^\+?\d[\d\s().-]{7,}\d$")
    date_text = F.col("value").rlike(r"\D") & parse_date("value").isNotNull()
    public = ~F.coalesce(personal, F.lit(False)) & national_id("value").isNull() & ~phone & ~date_text
    rest = ~F.coalesce("field", F.lit("")).isin("person", "staff_id", "national_id", "amount", "doc_date")
    # A row's cells are as few as its sheet has columns.
    wide = body.groupBy(*ROW).agg(
        *[get(f) for f in V.FIELD_SYNONYMS],
        F.array_sort(F.collect_list(F.when(public, F.struct("col", "value")))).alias("_text"),
        F.map_from_entries(F.collect_list(F.when(rest & F.col("key").isNotNull(), F.struct("key", "value")))).alias("raw_columns"))
    wide = wide.join(amount_head, SHEET, "left")
    nid, sid = national_id("national_id"), staff_id("staff_id")
    parsed = parse_amount("amount")
    text = F.array_join(F.transform("_text", lambda x: x["value"]), " | ")
    masked = F.when(nid.isNotNull(), F.concat(F.lit("ID "), F.left(nid, F.lit(3)), F.lit("******"))).when(
        sid.isNotNull(), F.concat(F.lit("Staff "), sid)).otherwise("")
    lines = wide.withColumns({"_nid": nid, "_sid": sid, "_p": parsed}).filter(
        F.col("person").isNotNull() | F.col("_sid").isNotNull() | F.col("_nid").isNotNull())
    out = lines.select(
        "source_seq", F.col("file").alias("source_file"), F.lit(V.GENERIC).alias("source_type"),
        (F.col("row") + 1).cast("bigint").alias("row_no"), "sheet",
        parse_date("doc_date").alias("doc_date"),
        F.coalesce("person", F.when(text != "", text), masked).alias("description"),
        F.col("person").alias("person_raw"), F.col("_sid").alias("staff_id_raw"), F.col("_nid").alias("national_id_raw"),
        F.col("_p.value").alias("amount"), F.coalesce(currency_of("currency"), currency_of("amount_key")).alias("currency"),
        "site_label", category_hint("file", "sheet").alias("category"), F.col("_p.note").alias("amount_note"),
        "raw_columns")
    return drop_total_rows(out)


def column_names(cells: DataFrame, headers: DataFrame) -> DataFrame:
    return column_keys(cells, headers).select(*SHEET, "col", "key")


def _repeat_edges(p: DataFrame, sheets: DataFrame) -> DataFrame:
    """source_seq, sheet, other: sheets of which a share of persons is in an earlier sheet of the file.

    A contained sheet shares one of any `n - needed + 1` of its persons with the
    sheet that holds it, so only that many of its rarest persons are looked up.
    Which they are follows from counts per frequency, so no sheet is sorted."""
    p = cut_lineage(p.join(sheets, ["source_seq", "sheet"]))
    often = p.groupBy("source_seq", "key").agg(F.count(F.lit(1)).alias("often"))
    p = cut_lineage(p.join(often, ["source_seq", "key"]).withColumn(
        "step", F.struct("often", F.pmod(F.xxhash64("key"), F.lit(64)).alias("part"))))
    upto = Window.partitionBy("source_seq", "sheet").orderBy("step").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    steps = p.groupBy("source_seq", "sheet", "n", "step").agg(F.count(F.lit(1)).alias("c")).withColumn(
        "upto", F.sum("c").over(upto))
    last = steps.filter(F.col("upto") > F.col("n") - F.ceil(V.REPEAT_SHARE * F.col("n"))).groupBy(
        "source_seq", "sheet").agg(F.min("step").alias("last"))
    rare = p.join(last, ["source_seq", "sheet"]).filter(F.col("step") <= F.col("last"))
    other = p.select("source_seq", "key", F.col("sheet").alias("other"), F.col("rank").alias("other_rank"))
    pairs = cut_lineage(rare.join(other, ["source_seq", "key"]).filter(F.col("other_rank") < F.col("rank")).select(
        "source_seq", "sheet", "n", "other").distinct())
    members = p.select("source_seq", "sheet", "key")
    shared = pairs.join(members, ["source_seq", "sheet"]).join(
        members.withColumnRenamed("sheet", "other"), ["source_seq", "other", "key"]).groupBy(
        "source_seq", "sheet", "n", "other").agg(F.count(F.lit(1)).alias("c"))
    return shared.filter(F.col("c") >= V.REPEAT_SHARE * F.col("n")).select("source_seq", "sheet", "other")


def _primary_sheets(edges: DataFrame) -> DataFrame:
    """source_seq, sheet: sheets that others may repeat, as a pass in rank order leaves them.

    Each round settles every sheet whose earlier sheets are settled: next to a
    primary one it repeats, with no primary one left it is primary itself. The
    earliest open sheet is settled in any case, so rounds end."""
    on = ["source_seq", "sheet"]
    target = edges.select("source_seq", F.col("other").alias("sheet")).distinct()
    primary = cut_lineage(target.join(edges, on, "left_anti"))
    found, fresh = primary, primary
    while not edges.isEmpty():
        hit = edges.join(fresh.withColumnRenamed("sheet", "other"), ["source_seq", "other"], "left_semi")
        repeats = cut_lineage(hit.select(*on).distinct())
        open_ = edges.join(repeats, on, "left_anti")
        left = cut_lineage(open_.join(repeats.withColumnRenamed("sheet", "other"), ["source_seq", "other"], "left_anti"))
        fresh = cut_lineage(open_.select(*on).distinct().join(left, on, "left_anti"))
        found, edges = found.unionByName(fresh), left
    return cut_lineage(found)


def mark_repeat_sheets(lines: DataFrame) -> DataFrame:
    """H7: sheets whose persons are 80 % contained in a larger sheet of the file.

    Sheets are settled largest first (then by first row and name): a sheet close
    to an earlier primary one repeats the first such. Sheets with equal persons
    go as one, so copies do not meet each other. Sheets without a name or
    persons repeat nothing; an empty table gives an empty result."""
    norm = name_norm("person_raw")
    key = F.coalesce(F.concat(F.lit("S:"), F.nullif("staff_id_raw", F.lit(""))),
                     F.concat(F.lit("T:"), F.nullif("national_id_raw", F.lit(""))),
                     F.when(norm != "", F.concat(F.lit("I:"), norm)))
    on = ["source_seq", "sheet"]
    rows = lines.select(*on, key.alias("key"), "row_no").filter("key is not null and sheet <> ''")
    p = cut_lineage(rows.groupBy(*on, "key").agg(F.min("row_no").alias("row")))
    digest = lambda salt: F.sum(F.xxhash64("key", F.lit(salt)).cast("decimal(38,0)"))
    size = cut_lineage(p.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), digest(1).alias("d1"), digest(2).alias("d2")).filter(
        F.col("n") >= V.REPEAT_MIN).select(
        *on, "n", "d1", "d2", F.struct((-F.col("n")).alias("o"), "row", "sheet").alias("rank")))
    same = size.groupBy("source_seq", "n", "d1", "d2").agg(F.min("rank").alias("rank"))
    heads = same.select("source_seq", F.col("rank.sheet").alias("sheet"), "n", "rank")
    edges = cut_lineage(_repeat_edges(p.drop("row"), heads))
    primary = _primary_sheets(edges)
    ranks = size.select("source_seq", F.col("sheet").alias("other"), F.col("rank").alias("other_rank"))
    settled = edges.join(primary, on, "left_anti").join(
        primary.withColumnRenamed("sheet", "other"), ["source_seq", "other"], "left_semi").join(
        ranks, ["source_seq", "other"]).groupBy(*on).agg(F.min_by("other", "other_rank").alias("repeats"))
    # What holds for the first of equal sheets holds for all; where it is primary, the others repeat it.
    twins = size.select(*on, "n", "d1", "d2").join(
        same.select("source_seq", "n", "d1", "d2", F.col("rank.sheet").alias("head")), ["source_seq", "n", "d1", "d2"])
    marked = twins.join(settled.withColumnRenamed("sheet", "head"), ["source_seq", "head"], "left").select(
        *on, F.coalesce("repeats", F.when(F.col("head") != F.col("sheet"), F.col("head"))).alias("repeats")).filter(
        "repeats is not null")
    return lines.join(cut_lineage(marked), on, "left")


def classify_feeds(cells: DataFrame, headers: DataFrame, resolved: DataFrame) -> DataFrame:
    """Feed type by ordered rules over header text; data cells never vote.

    Returns the first type and the ordered list of fallbacks."""
    head = cells.join(headers, SHEET, "left").filter(
        F.col("row") <= F.coalesce("header_row", F.lit(-1))).select("source_seq", "file", column_key("value").alias("key"))
    names = cells.select("source_seq", "file", column_key("sheet").alias("key"))
    # Header texts of one file: at most fifteen rows per sheet, made distinct first.
    texts = head.unionByName(names).filter("key <> ''").distinct().groupBy("source_seq", "file").agg(
        F.array_sort(F.collect_set("key")).alias("keys"))
    preview = cells.filter(F.col("row") < V.HEADER_ROWS).join(
        resolved.filter("field = 'amount'").select(*SHEET, "col", "header_row"), [*SHEET, "col"]).filter(
        F.col("row") > F.col("header_row"))
    paid = preview.filter(parse_amount("value")["value"].isNotNull()).select("source_seq").distinct().withColumn(
        "has_amount", F.lit(True))
    files = cells.select("source_seq", "file").distinct().join(texts, ["source_seq", "file"], "left").join(
        paid, "source_seq", "left")
    blob = F.array_join(F.coalesce("keys", F.array().cast("array<string>")), " || ")

    def holds(word):
        if word == "!amount":
            return ~F.coalesce("has_amount", F.lit(False))
        if word.startswith("="):
            return F.coalesce(F.array_contains("keys", word[1:]), F.lit(False))
        return blob.contains(word)

    types = []
    for kind, groups in V.FEED_RULES:
        rule = F.lit(False)
        for words in groups:
            every = F.lit(True)
            for w in words:
                every = every & holds(w)
            rule = rule | every
        types.append(F.when(rule, F.lit(kind)))
    files = files.withColumn("types", F.filter(F.array(*types), lambda t: t.isNotNull()))
    return files.select("source_seq", "file", F.get("types", F.lit(0)).alias("source_type"), "types")
