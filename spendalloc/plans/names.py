"""Queries over names: keys, roster statistics and the identity steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import FEMININE_ENDINGS
from ..functions.text import clean_person, fold, letter_sig, masculine, name_norm, token_key, tokens
from ..operators import cascade as C
from ..operators import ledgers, measure, roster
from ..operators.centers import decide_match
from ..operators.common import cut_lineage, keep, release
from . import views as V

_MATCH = ["norm", "staff_id", "method", "confidence", "candidate_count"]


def _base(spark, d):
    """The name roster, read from the documents once per query."""
    return cut_lineage(V.roster(spark, d, deal=True))


def _both(spark, d):
    """(distinct names of the mentions, roster indexes); the roster's rows go when both are written."""
    base = _base(spark, d)
    names, r = cut_lineage(C.open_names(C.mentions(V.mention(spark, d, base)))), roster.build_roster(base).write()
    release(base)
    return names, r


def _settled(out: DataFrame, names: DataFrame, r: roster.Roster) -> DataFrame:
    """Matches of settled candidates, which are written with all that they need: names and indexes go."""
    release(names)
    r.release()
    return out.select(*_MATCH)


# --- N1-N5, N20 --------------------------------------------------------------

def name_keys(spark, d) -> DataFrame:
    """Folded text, canonical form, word set and letters of whole documents (as checksums)."""
    t = V.load(spark, d, "documents").select("doc_id", "text")
    t = t.withColumn("norm", name_norm("text"))
    return t.select("doc_id", F.md5(fold("text")).alias("folded"), F.md5("norm").alias("norm"),
                    F.md5(token_key("norm")).alias("tkey"), F.md5(letter_sig("norm")).alias("sig"))


NAME_KEYS = f"""
WITH t AS (SELECT doc_id, {V.fold_sql('text')} AS folded, {V.norm_sql('text')} AS norm FROM documents)
SELECT doc_id, md5(folded) AS folded, md5(norm) AS norm, md5({V.TKEY_SQL.format('norm')}) AS tkey,
       md5({V.SIG_SQL.format('norm')}) AS sig FROM t"""


def clean_text(spark, d) -> DataFrame:
    """Cleaned description of every message, as length and checksum."""
    t = V.load(spark, d, "conversations").withColumn(
        "c", clean_person(F.concat(F.lit("TK1234567890 "), "text", F.lit(" IST-CDG (2) [11.07.2026] 1/3 BILET BEDELI"))))
    return t.select("conv_id", "turn", F.length("c").alias("n"), F.md5("c").alias("cleaned"))


def surname_forms(spark, d) -> DataFrame:
    """Masculine form of the words of every document, counted."""
    w = V.load(spark, d, "documents").select(F.explode(F.split(name_norm("text"), " ")).alias("word")).filter("word <> ''")
    w = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("base", masculine("word")).filter("base is not null")


_ENDS = FEMININE_ENDINGS
SURNAME_FORMS = f"""
WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split({V.norm_sql('text')}, ' ')) AS word FROM documents)
           WHERE word <> '' GROUP BY 1)
SELECT word, n, CASE {' '.join(f"WHEN word LIKE '%{a}' AND length(word) - {len(a)} >= 3 THEN left(word, length(word) - {len(a)}) || '{b}'" for a, b in _ENDS)} END AS base
FROM w WHERE length(word) >= 6 AND base IS NOT NULL"""


# --- R2-R5 -------------------------------------------------------------------

_IDS = f"""
v_ids AS (SELECT norm, staff_id, min(doc_id) AS seq, any_value(site) AS site, {V.TKEY_SQL.format('norm')} AS tkey
          FROM v_roster WHERE norm <> '' GROUP BY norm, staff_id),
v_rn AS (SELECT DISTINCT norm, list_sort(list_distinct(string_split(norm, ' '))) AS toks, tkey,
                string_split(norm, ' ')[1] AS surname FROM v_ids),
v_freq AS (SELECT token, count(*) AS freq, count(*) FILTER (token = surname) AS n_surname
           FROM (SELECT unnest(toks) AS token, surname FROM v_rn) GROUP BY 1)"""


def token_stats(spark, d) -> DataFrame:
    """Document frequency of name words and how often each is a surname."""
    n = roster.roster_names(roster.name_index(V.roster(spark, d)))
    f = roster.token_freq(n)
    s = roster.surname_stats(n)
    return f.join(s, "token").select("token", "freq", "n_surname")


TOKEN_STATS = V.with_sql("SELECT token, freq, n_surname FROM v_freq", V.ROSTER, _IDS)


def roster_profile(spark, d) -> DataFrame:
    """Profile of the snapshots."""
    return roster.roster_profile(V.snap(spark, d))


ROSTER_PROFILE = V.with_sql(f"""
SELECT count(*) AS n_rows, count(DISTINCT s.staff_id) AS n_ids, count(DISTINCT s.staff_id) AS n_named_ids,
       0 AS n_nameless_rows, count(DISTINCT period) AS n_periods, min(period) AS first_period, max(period) AS last_period,
       count(DISTINCT site) AS n_sites,
       (SELECT count(*) FROM v_clash) AS n_names, (SELECT count(*) FILTER (n > 1) FROM v_clash) AS n_colliding_names,
       (SELECT coalesce(sum(n) FILTER (n > 1), 0) FROM v_clash) AS n_colliding_ids
FROM v_snap s""", V.SNAP, f"""
v_clash AS (SELECT {V.norm_sql('c_name')} AS norm, count(DISTINCT o_custkey) AS n
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)""")


def secondary_profile(spark, d) -> DataFrame:
    """Persons per company, the ten largest."""
    return roster.secondary_profile(V.load(spark, d, "documents").select(F.col("source").alias("company2")))


SECONDARY_PROFILE = """
SELECT source AS company, count(*) AS n_persons FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


# --- J5, J7-J9 ---------------------------------------------------------------

_NAMES = f"""
v_names AS (SELECT DISTINCT mnorm AS norm, list_sort(list_distinct(string_split(mnorm, ' '))) AS toks,
                   {V.TKEY_SQL.format('mnorm')} AS tkey FROM v_mention WHERE mnorm <> '')"""


def _settle(source: str) -> str:
    """SQL of the candidate rule over (norm, staff_id, site, seq, other, method, confidence)."""
    return f"""
SELECT norm, CASE WHEN n = 1 OR same THEN first END AS staff_id, method,
       CAST(CASE WHEN n = 1 THEN conf WHEN same THEN 0.58 ELSE 0.55 END AS DOUBLE) AS confidence, n AS candidate_count
FROM (SELECT norm, any_value(method) AS method, max(confidence) AS conf, count(*) AS n, min(site) = max(site) AS same,
             arg_min(staff_id, (other, seq, staff_id)) AS first
      FROM (SELECT norm, staff_id, any_value(site) AS site, min(other) AS other, min(seq) AS seq, any_value(method) AS method,
                   max(CAST(confidence AS DOUBLE)) AS confidence FROM ({source}) GROUP BY 1, 2) GROUP BY norm)"""


def exact_match(spark, d) -> DataFrame:
    """Same name or same word set, with the rule for several candidates."""
    n, r = _both(spark, d)
    return _settled(C.by_exact(n, r), n, r)


_EXACT = """SELECT n.norm, i.staff_id, i.site, i.seq, CAST(i.norm <> n.norm AS INTEGER) AS other,
              'exact_name' AS method, 0.95 AS confidence FROM v_names n JOIN v_ids i USING (tkey)"""
EXACT_MATCH = V.with_sql(_settle(_EXACT), V.ROSTER, V.MENTION, _IDS, _NAMES)


def _with_surplus(names, base) -> DataFrame:
    """Mention names, and roster names with one more word."""
    r = base.filter("full_name <> ''").select(F.concat("full_name", F.lit(" SRC")).alias("norm"))
    extra = r.distinct().withColumns({"toks": tokens("norm"), "tkey": token_key("norm")})
    return names.unionByName(extra).distinct()


def subset_join(spark, d) -> DataFrame:
    """Names inside a longer roster name, and roster names inside a longer name."""
    base = _base(spark, d)
    n = cut_lineage(_with_surplus(C.open_names(C.mentions(V.mention(spark, d, base))), base))
    r = roster.build_roster(base).write()
    release(base)
    sub = C.by_subset(n, r).select(*_MATCH)
    sup = C.by_superset(n, r).select(*_MATCH)
    return sub.withColumn("step", F.lit("subset")).unionByName(sup.withColumn("step", F.lit("superset")))


_BIGGER = f"""
v_more AS (SELECT norm, toks, tkey FROM v_names UNION
           SELECT norm || ' SRC', list_sort(list_distinct(string_split(norm || ' SRC', ' '))), {V.TKEY_SQL.format("norm || ' SRC'")}
           FROM v_roster WHERE norm <> ''),
v_rt AS (SELECT norm AS rnorm, toks AS rtoks, surname, unnest(toks) AS token FROM v_rn),
v_mt AS (SELECT norm, toks, unnest(toks) AS token FROM v_more),
v_mr AS (SELECT norm, toks, arg_min(token, (freq, token)) AS token FROM v_mt JOIN v_freq USING (token)
         GROUP BY norm, toks HAVING count(*) = len(toks) AND len(toks) >= 2),
v_rr AS (SELECT rnorm, rtoks, arg_min(token, (freq, token)) AS token FROM v_rt JOIN v_freq USING (token) GROUP BY rnorm, rtoks),
v_lex AS (SELECT norm, list(token) AS known FROM v_mt JOIN v_freq USING (token) GROUP BY norm),
v_sub0 AS (SELECT norm, rnorm, list_contains(toks, surname) AS sn FROM v_mr JOIN v_rt USING (token)
           WHERE len(rtoks) > len(toks) AND list_has_all(rtoks, toks)),
v_sub AS (SELECT s.norm, i.staff_id, i.site, i.seq, 0 AS other, 'subset' AS method,
                 CASE WHEN any_sn THEN 0.90 ELSE 0.72 END AS confidence
          FROM v_sub0 s JOIN (SELECT norm, bool_or(sn) AS any_sn FROM v_sub0 GROUP BY 1) b USING (norm)
          JOIN v_ids i ON i.norm = s.rnorm WHERE NOT any_sn OR sn),
v_sup0 AS (SELECT norm, rnorm, len(list_filter(known, lambda t: NOT list_contains(rtoks, t))) > 0 AS named
           FROM v_mt JOIN v_rr USING (token) JOIN v_lex USING (norm)
           WHERE len(toks) >= 3 AND len(rtoks) >= 2 AND len(rtoks) < len(toks) AND list_has_all(toks, rtoks)),
v_sup AS (SELECT s.norm, i.staff_id, i.site, i.seq, 0 AS other, 'subset' AS method, 0.72 AS confidence
          FROM v_sup0 s JOIN v_ids i ON i.norm = s.rnorm),
v_supset AS ({_settle('SELECT * FROM v_sup')}),
v_third AS (SELECT norm, bool_and(named) AS third FROM v_sup0 GROUP BY 1)"""
SUBSET_JOIN = V.with_sql(f"""
SELECT norm, staff_id, method, confidence, candidate_count, 'subset' AS step FROM ({_settle('SELECT * FROM v_sub')})
UNION ALL
SELECT norm, CASE WHEN NOT third THEN staff_id END, method, CAST(CASE WHEN third THEN 0.5 ELSE confidence END AS DOUBLE), candidate_count, 'superset'
FROM v_supset JOIN v_third USING (norm)""", V.ROSTER, V.MENTION, _IDS, _NAMES, _BIGGER)


def unjoined_names(spark, d) -> DataFrame:
    """Glued words opened by the roster's own words, then matched exactly."""
    n, r = _both(spark, d)
    rest = n.join(r.ids.select("tkey").distinct(), "tkey", "left_anti")
    opened = C.unjoined_names(rest, r)
    return _settled(C.by_exact(opened, r, 0.92), n, r)


UNJOINED_NAMES = V.with_sql(_settle("""
SELECT o.norm, i.staff_id, i.site, i.seq, CAST(i.norm <> o.norm AS INTEGER) AS other, 'exact_name' AS method, 0.92 AS confidence
FROM v_open o JOIN v_ids i USING (tkey)"""), V.ROSTER, V.MENTION, _IDS, _NAMES, """
v_rest AS (SELECT * FROM v_names WHERE tkey NOT IN (SELECT tkey FROM v_ids)),
v_unk AS (SELECT DISTINCT norm, token FROM (SELECT norm, unnest(toks) AS token FROM v_rest)
          WHERE token NOT IN (SELECT token FROM v_freq) AND length(token) >= 6),
v_two AS (SELECT token, arg_max([left(token, i), token[i+1:]], i) AS parts
          FROM (SELECT DISTINCT token, unnest(range(3, length(token) - 2)) AS i FROM v_unk)
          WHERE left(token, i) IN (SELECT token FROM v_freq) AND token[i+1:] IN (SELECT token FROM v_freq) GROUP BY 1),
v_cut AS (SELECT token, i, unnest(range(3, length(token) - i - 2)) AS j
          FROM (SELECT DISTINCT token, unnest(range(3, length(token) - 5)) AS i FROM v_unk WHERE token NOT IN (SELECT token FROM v_two))),
v_three AS (SELECT token, arg_min([left(token, i), token[i+1:i+j], token[i+j+1:]], (i, j)) AS parts FROM v_cut
            WHERE left(token, i) IN (SELECT token FROM v_freq) AND token[i+1:i+j] IN (SELECT token FROM v_freq)
              AND token[i+j+1:] IN (SELECT token FROM v_freq) GROUP BY 1),
v_parts AS (SELECT * FROM v_two UNION ALL SELECT * FROM v_three),
v_open AS (SELECT norm, array_to_string(list_sort(list_distinct(flatten(list(coalesce(parts, [token]))))), ' ') AS tkey
           FROM (SELECT norm, unnest(toks) AS token FROM v_rest WHERE norm IN (SELECT norm FROM v_unk JOIN v_parts USING (token)))
           LEFT JOIN v_parts USING (token) GROUP BY norm)""")


# --- J1-J4, J6, J12, P12 -----------------------------------------------------

def _nid(number):
    """An eleven-digit national id from a number."""
    return F.concat(F.lit("1"), F.lpad((number % 10_000_000_000).cast("string"), 10, "0"))


def _known(spark, d):
    """Mentions with ids and ledgers derived from the names' numbers."""
    base = _base(spark, d)
    m = V.mention(spark, d, base)
    k = F.col("row_no")
    m = m.withColumns({
        "staff_id_raw": F.when(k % 7 == 0, F.concat(k, F.lit(".0"))).when(k % 7 == 1, F.concat(F.lit("X"), k)),
        "national_id_raw": F.when(k % 5 == 0, _nid(k))})
    r = base.withColumn("norm", name_norm("full_name")).filter("norm <> ''")
    s = F.col("load_seq")
    ledger = {
        "bridge": r.filter(s % 10 == 0).select(
            _nid(s).alias("national_id"), "staff_id", "load_seq"),
        "alias": r.groupBy("norm").agg(F.max_by("staff_id", "load_seq").alias("staff_id"), F.max("load_seq").alias("load_seq"))
                  .filter(F.col("load_seq") % 11 == 2).withColumnRenamed("norm", "name_norm"),
        "external": r.filter(s % 13 == 3).select(F.col("norm").alias("name_norm"), "full_name", "load_seq"),
        "extra": r.filter(s % 3 == 0).select(F.col("norm").alias("key"), "full_name", "load_seq"),
    }
    return m, r, ledger, base


def known_identities(spark, d) -> DataFrame:
    """Ids on the line, bridged national ids, aliases and external persons."""
    m, _, ledger, base = _known(spark, d)
    r = roster.build_roster(base)
    men = cut_lineage(C.mentions(m))
    # Each step is written with the few columns that count, so that its shuffles and what it alone reads go before the next.
    one = lambda df, step, key: cut_lineage(df.select(
        F.lit(step).alias("step"), key.alias("key"), "staff_id", "confidence", "candidate_count"))
    mention = F.concat_ws("|", "sid", "nid", "norm", "pref")
    given = one(C.by_staff_id(men, r.latest), "staff_id", mention)
    bridged = one(C.by_national_id(men, ledger["bridge"], r.latest), "national_id", mention)
    names = cut_lineage(C.open_names(men))
    release(men)
    alias = one(C.by_alias(names, ledger["alias"], r), "alias", F.col("norm"))
    r.release()
    external = one(C.by_external(names, ledger["external"]), "external", F.col("norm"))
    release(names, base)
    return given.unionByName(bridged).unionByName(alias).unionByName(external)


_KNOWN = f"""
v_m AS (SELECT DISTINCT CASE doc_id % 7 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN 'X' || doc_id ELSE '' END AS sid,
               CASE WHEN doc_id % 5 = 0 THEN '1' || lpad(CAST(doc_id % 10000000000 AS VARCHAR), 10, '0') ELSE '' END AS nid, mnorm AS norm,
               CASE WHEN category = 'Bilet' THEN 'first' ELSE 'last' END AS pref FROM v_mention),
v_r AS (SELECT *, string_split(norm, ' ') AS rt FROM v_roster),
v_bridge AS (SELECT '1' || lpad(CAST(doc_id % 10000000000 AS VARCHAR), 10, '0') AS national_id, staff_id FROM v_roster WHERE norm <> '' AND doc_id % 10 = 0),
v_alias0 AS (SELECT norm, arg_max(staff_id, doc_id) AS aid, max(doc_id) AS seq FROM v_roster WHERE norm <> '' GROUP BY 1),
v_alias AS (SELECT *, {V.TKEY_SQL.format('norm')} AS tkey FROM v_alias0 WHERE seq % 11 = 2),
v_aliast AS (SELECT tkey, arg_min(aid, seq) AS tid FROM v_alias GROUP BY 1),
v_ext AS (SELECT norm, {V.TKEY_SQL.format('norm')} AS tkey, {V.SIG_SQL.format('norm')} AS sig FROM v_roster WHERE norm <> '' AND doc_id % 13 = 3)"""
KNOWN_IDENTITIES = V.with_sql(f"""
SELECT step, key, staff_id, CAST(confidence AS DOUBLE) AS confidence, candidate_count FROM (
SELECT 'staff_id' AS step, sid || '|' || nid || '|' || m.norm || '|' || pref AS key, sid AS staff_id,
       CASE WHEN m.norm = '' OR r.norm = '' OR list_has_any(string_split(m.norm, ' '), rt) THEN 1.0 ELSE 0.75 END AS confidence, 1 AS candidate_count
FROM v_m m JOIN v_r r ON sid = staff_id
UNION ALL
SELECT 'national_id', sid || '|' || nid || '|' || m.norm || '|' || pref, b.staff_id,
       CASE WHEN m.norm = '' OR r.norm = '' OR list_has_any(string_split(m.norm, ' '), rt) THEN 0.99 ELSE 0.75 END, 1
FROM v_m m JOIN v_bridge b ON nid = national_id JOIN v_r r ON b.staff_id = r.staff_id
UNION ALL
SELECT 'alias', norm, aid, CASE WHEN n > 0 THEN 0.75 ELSE 0.98 END, 1 + n
FROM (SELECT h.norm, h.aid, (SELECT count(DISTINCT staff_id) FROM v_ids i WHERE i.tkey = h.tkey AND i.staff_id <> h.aid) AS n
      FROM (SELECT x.norm, x.tkey, coalesce(a.aid, tid) AS aid FROM v_names x LEFT JOIN v_alias a ON a.norm = x.norm
            LEFT JOIN v_aliast t ON t.tkey = x.tkey) h WHERE aid IS NOT NULL)
UNION ALL
SELECT 'external', norm, NULL, 0.95, 0 FROM v_names x
WHERE norm IN (SELECT norm FROM v_ext) OR tkey IN (SELECT tkey FROM v_ext) OR {V.SIG_SQL.format('norm')} IN (SELECT sig FROM v_ext))""",
                             V.ROSTER, V.MENTION, _IDS, _NAMES, _KNOWN)


def secondary_match(spark, d) -> DataFrame:
    """The undated roster and the extra-person ledger."""
    m, r, ledger, base = _known(spark, d)
    names = cut_lineage(C.open_names(C.mentions(m)))
    sec = r.withColumn("tkey", token_key("norm")).filter(F.col("load_seq") % 2 == 0)
    main = roster.latest(base).filter(F.col("load_seq") % 4 == 0)
    out = cut_lineage(C.by_secondary(names, sec, main).select("norm", "staff_id", "method", "confidence", "candidate_count"))
    extra = C.by_extra(names.select(F.lit("").alias("nid"), "norm"), ledger["extra"]).select(
        "norm", "staff_id", "method", "confidence", "candidate_count")
    return out.unionByName(extra)


SECONDARY_MATCH = V.with_sql(f"""
SELECT norm, staff_id, method, CAST(confidence AS DOUBLE) AS confidence, candidate_count FROM (
SELECT norm, CASE WHEN n = 1 THEN sid END AS staff_id,
       CASE WHEN n = 1 AND main THEN 'exact_name' ELSE 'secondary' END AS method,
       CASE WHEN n = 1 AND main THEN 0.92 WHEN n = 1 THEN 0.90 ELSE 0.55 END AS confidence, n AS candidate_count
FROM (SELECT norm, count(DISTINCT staff_id) AS n, arg_min(staff_id, doc_id) AS sid, arg_min(doc_id, doc_id) % 4 = 0 AS main
      FROM (SELECT x.norm, s.staff_id, s.doc_id, s.norm = x.norm AS same, bool_or(s.norm = x.norm) OVER (PARTITION BY x.norm) AS any_same
            FROM v_names x JOIN v_sec s USING (tkey)) WHERE same OR NOT any_same GROUP BY norm)
UNION ALL
SELECT norm, NULL, 'extra', 0.70, 0 FROM v_names
WHERE norm IN (SELECT norm FROM v_extra) OR tkey IN (SELECT tkey FROM v_extra WHERE norm LIKE '% %'))""",
                            V.ROSTER, V.MENTION, _IDS, _NAMES, f"""
v_sec AS (SELECT norm, staff_id, doc_id, {V.TKEY_SQL.format('norm')} AS tkey FROM v_roster WHERE norm <> '' AND doc_id % 2 = 0),
v_extra AS (SELECT norm, {V.TKEY_SQL.format('norm')} AS tkey FROM v_roster WHERE norm <> '' AND doc_id % 3 = 0)""")


# --- J14-J16 -----------------------------------------------------------------

def family(spark, d) -> DataFrame:
    """Relatives by surname, with the certain matches of the same run as evidence."""
    base = _base(spark, d)
    m = cut_lineage(C.mentions(V.mention(spark, d, base)))
    r = roster.build_roster(base).write()
    release(base)
    exact = C.by_exact(C.open_names(m), r)
    sure = C.family_evidence(m.join(exact, "norm"), r.latest)
    rest = m.filter("norm <> ''").withColumn("tkey", token_key("norm")).join(
        r.ids.select("tkey").distinct(), "tkey", "left_anti")
    return C.by_family(rest, sure, r).select("norm", "pref", "staff_id", "confidence", "candidate_count")


FAMILY = V.with_sql(f"""
SELECT norm, pref, CASE WHEN grade = 3 THEN sure_id WHEN grade > 0 THEN first END AS staff_id,
       CAST(CASE grade WHEN 3 THEN 0.60 WHEN 2 THEN 0.50 WHEN 1 THEN 0.45 ELSE 0.30 END AS DOUBLE) AS confidence, n AS candidate_count
FROM (SELECT *, row_number() OVER (PARTITION BY norm, pref ORDER BY grade DESC, p DESC, liked DESC, is_first DESC) AS rn
      FROM v_graded) WHERE rn = 1""", V.ROSTER, V.MENTION, _IDS, _NAMES, f"""
v_exact AS ({_settle(_EXACT)}),
v_sure0 AS (SELECT DISTINCT x.staff_id, string_split(r.norm, ' ')[1] AS surname FROM v_exact x JOIN v_roster r ON x.staff_id = r.staff_id
            WHERE x.staff_id IS NOT NULL AND candidate_count = 1),
v_sure AS (SELECT surname, count(DISTINCT staff_id) AS n_sure, min(staff_id) AS sure_id FROM v_sure0 GROUP BY 1),
v_hold AS (SELECT string_split(norm, ' ')[1] AS surname, count(DISTINCT staff_id) AS n, min(site) = max(site) AS same,
                  arg_min(staff_id, (seq, staff_id)) AS first FROM v_ids GROUP BY 1),
v_rest AS (SELECT DISTINCT mnorm AS norm, CASE WHEN category = 'Bilet' THEN 'first' ELSE 'last' END AS pref,
                  string_split(mnorm, ' ') AS w FROM v_mention
           WHERE mnorm <> '' AND {V.TKEY_SQL.format('mnorm')} NOT IN (SELECT tkey FROM v_ids)),
v_ends0 AS (SELECT norm, pref, 'first' AS pos, w[1] AS token FROM v_rest WHERE len(w) >= 2
            UNION ALL SELECT norm, pref, 'last', w[-1] FROM v_rest WHERE len(w) >= 2),
v_ends1 AS (SELECT e.*, coalesce(n_surname / freq, 0.0) AS p FROM v_ends0 e LEFT JOIN v_freq f USING (token) WHERE length(token) >= 3),
v_ends AS (SELECT *, max(p) OVER (PARTITION BY norm, pref) AS best FROM v_ends1),
v_kept AS (SELECT *, CASE WHEN token IN (SELECT surname FROM v_hold) THEN token ELSE
             CASE WHEN length(token) >= 6 THEN CASE {' '.join(f"WHEN token LIKE '%{a}' AND length(token) - {len(a)} >= 3 THEN left(token, length(token) - {len(a)}) || '{b}'" for a, b in _ENDS)} END END END AS surname
           FROM v_ends WHERE (pref = pos OR p >= 0.5) AND NOT (best >= 0.5 AND p < 0.1 AND p < best)),
v_graded AS (SELECT k.norm, k.pref, h.n, h.first, s.sure_id, p, CAST(pref = pos AS INTEGER) AS liked, CAST(pos = 'first' AS INTEGER) AS is_first,
                    CASE WHEN h.n <= 8 AND coalesce(n_sure, 0) = 1 THEN 3 WHEN h.n = 1 THEN 2 WHEN h.same AND h.n <= 8 THEN 1 ELSE 0 END AS grade
             FROM v_kept k JOIN v_hold h USING (surname) LEFT JOIN v_sure s USING (surname))""")


# --- scored steps and the whole cascade (no equivalent SQL) -------------------

def translit(spark, d) -> DataFrame:
    """Spelling variants found in the roster."""
    n, r = _both(spark, d)
    return _settled(C.by_translit(n.join(r.ids.select("tkey").distinct(), "tkey", "left_anti"), r), n, r)


def prefix(spark, d) -> DataFrame:
    """Truncated names."""
    n, r = _both(spark, d)
    return _settled(C.by_prefix(n.join(r.ids.select("tkey").distinct(), "tkey", "left_anti"), r), n, r)


def fuzzy(spark, d) -> DataFrame:
    """Similar names."""
    n, r = _both(spark, d)
    return C.by_fuzzy(n.join(r.ids.select("tkey").distinct(), "tkey", "left_anti"), r).select(*_MATCH)


def cascade_methods(spark, d) -> DataFrame:
    """Lines per method and confidence after the whole cascade."""
    m, _, ledger, base = _known(spark, d)
    out = C.match_lines(m, roster.build_roster(base), ledger)
    return out.groupBy("method", "confidence", decide_match().alias("decision")).agg(F.count(F.lit(1)).alias("n_lines"))


def person_search(spark, d) -> DataFrame:
    """The best five persons for every name of the manual file."""
    base = _base(spark, d)
    q = V.mention(spark, d, base).select(F.col("person_raw").alias("query")).filter("query <> ''")
    return roster.search(q, roster.build_roster(base), 5)


def unmatched_causes(spark, d) -> DataFrame:
    """M2: why names without an exact match have no person."""
    base = _base(spark, d)
    m = V.mention(spark, d, base)
    r = roster.build_roster(base)
    key = token_key(name_norm("person_raw"))
    lines = m.withColumn("tkey", key).join(r.ids.select("tkey").distinct().withColumn("hit", F.lit(True)), "tkey", "left").withColumns({
        "decision": F.when(F.col("hit"), "AUTO").otherwise("UNMATCHED"), "method": F.lit("none"),
        "candidates": F.array().cast("array<string>"), "staff_id": F.lit(None).cast("string")})
    return measure.unmatched_causes(lines, r).groupBy("cause").agg(F.count(F.lit(1)).alias("n_lines"))


# --- learning ----------------------------------------------------------------

def _health(spark, d, base) -> DataFrame:
    """Mentions as a health register: national id, birth date, every third from another kind of feed."""
    m = V.mention(spark, d, base)
    k = F.col("row_no")
    return m.withColumns({
        "source_type": F.when(k % 3 == 0, "health").when(k % 3 == 1, "mediation").otherwise("travel_ledger"),
        "national_id_raw": F.when(k % 4 != 0, _nid(F.floor(k / 2))),
        "staff_id_raw": F.when(k % 9 == 0, k.cast("string"))})


def _health_keys(spark, d, base) -> DataFrame:
    """The register's lines with a national id and their keys, made once; written, as filters on made keys would make them anew."""
    return cut_lineage(ledgers.with_keys(_health(spark, d, base).filter("national_id_raw is not null")).select(
        *ledgers.LINE, "nid", "sid", "norm", "tkey", "trusted", "birth_date"))


_HEALTH = f"""
v_health AS (SELECT doc_id, mnorm AS norm, {V.TKEY_SQL.format('mnorm')} AS tkey, birth_date, site,
  CASE doc_id % 3 WHEN 0 THEN 'health' WHEN 1 THEN 'mediation' ELSE 'travel_ledger' END AS source_type,
  CASE WHEN doc_id % 4 <> 0 THEN '1' || lpad(CAST(doc_id // 2 % 10000000000 AS VARCHAR), 10, '0') ELSE '' END AS nid,
  CASE WHEN doc_id % 9 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS sid FROM v_mention)"""


def ledger_feed(spark, d) -> DataFrame:
    """L1: extra persons from trusted registers that are not staff."""
    base = _base(spark, d)
    ids = roster.name_index(base.filter(F.col("load_seq") % 2 == 0))
    extra, _, _ = ledgers.feed_ledgers(_health(spark, d, base), ids)
    return extra.select("key", "full_name", "site", "source")


LEDGER_FEED = V.with_sql("""
SELECT key, arg_max(norm, doc_id) AS full_name, arg_max(site, doc_id) AS site, arg_max(source_type, doc_id) AS source
FROM (SELECT *, CASE WHEN nid <> '' THEN nid ELSE norm END AS key FROM v_health
      WHERE source_type <> 'travel_ledger' AND (norm <> '' OR nid <> '')
        AND NOT (norm <> '' AND tkey IN (SELECT tkey FROM v_ids WHERE seq % 2 = 0)))
WHERE key <> '' GROUP BY 1""", V.ROSTER, V.MENTION, _IDS, _HEALTH)


def ledger_report(spark, d) -> DataFrame:
    """L1: what each source type contributed."""
    base = _base(spark, d)
    ids = roster.name_index(base.filter(F.col("load_seq") % 2 == 0))
    return ledgers.feed_ledgers(_health(spark, d, base), ids)[2]


LEDGER_REPORT = V.with_sql("""
SELECT source_type, count(*) AS n_lines, count(*) FILTER (trusted AND emp AND NOT anon) AS n_staff,
       count(*) FILTER (trusted AND anon) AS n_anonymous, count(*) FILTER (NOT trusted) AS n_not_trusted,
       count(DISTINCT CASE WHEN trusted AND NOT anon AND NOT emp THEN nullif(CASE WHEN nid <> '' THEN nid ELSE norm END, '') END) AS n_extra,
       count(DISTINCT CASE WHEN trusted AND nid <> '' AND sid <> '' THEN nid END) AS n_bridge
FROM (SELECT *, source_type <> 'travel_ledger' AS trusted, norm = '' AND nid = '' AS anon,
             norm <> '' AND tkey IN (SELECT tkey FROM v_ids WHERE seq % 2 = 0) AS emp FROM v_health) GROUP BY 1""",
                           V.ROSTER, V.MENTION, _IDS, _HEALTH)


def bridge_derive(spark, d) -> DataFrame:
    """L2: national ids tied to staff by name and birth date."""
    s = _base(spark, d)
    return ledgers.derive_bridge(_health(spark, d, s), cut_lineage(roster.name_index(s)), roster.latest(s))


BRIDGE_DERIVE = V.with_sql("""
SELECT nid AS national_id, arg_min(born, t0) AS staff_id, 'name_birth' AS method, CAST(0.97 AS DOUBLE) AS confidence
FROM (SELECT nid, norm, birth_date, t0, count(DISTINCT CASE WHEN rbirth = birth_date THEN cand END) AS n_born,
             min(CASE WHEN rbirth = birth_date THEN cand END) AS born
      FROM (SELECT p.*, i.staff_id AS cand, r.birth_date AS rbirth,
                   CASE WHEN i.norm = p.norm THEN 1 WHEN i.norm = array_to_string(list_reverse(string_split(p.norm, ' ')), ' ') THEN 2 ELSE 3 END AS way,
                   min(CASE WHEN i.norm = p.norm THEN 1 WHEN i.norm = array_to_string(list_reverse(string_split(p.norm, ' ')), ' ') THEN 2 ELSE 3 END)
                     OVER (PARTITION BY p.norm) AS best
            FROM (SELECT nid, norm, tkey, birth_date, min(doc_id) AS t0 FROM v_health WHERE nid <> '' AND norm <> '' GROUP BY ALL) p
            JOIN v_ids i USING (tkey) JOIN v_roster r ON r.staff_id = i.staff_id) WHERE way = best GROUP BY ALL)
WHERE n_born = 1 GROUP BY nid""", V.ROSTER, V.MENTION, _IDS, _HEALTH)


def alias_derive(spark, d) -> DataFrame:
    """L3: aliases by equal birth date and similar name."""
    s = _base(spark, d)
    last = roster.latest(s).withColumn("latest_norm", name_norm("full_name"))
    return ledgers.derive_alias(_health(spark, d, s), cut_lineage(roster.name_index(s)), cut_lineage(last))


def ledger_merge(spark, d) -> DataFrame:
    """Derived rows never replace known ones; human decisions do."""
    s = V.roster(spark, d).withColumn("norm", name_norm("full_name")).filter("norm <> ''")
    one = s.groupBy(F.col("norm").alias("name_norm")).agg(
        F.max_by("staff_id", "load_seq").alias("staff_id"), F.max("load_seq").alias("load_seq"))
    # The three tables are cuts of one; kept under its keys, it meets itself without another shuffle.
    one = keep(one)
    old = one.filter(F.col("load_seq") % 3 == 0).withColumn("source", F.lit("old"))
    new = one.withColumns({"staff_id": F.concat(F.lit("N"), "staff_id"), "source": F.lit("derived")})
    human = one.filter(F.col("load_seq") % 5 == 0).withColumns(
        {"staff_id": F.concat(F.lit("H"), "staff_id"), "source": F.lit("human")})
    kept = ledgers.merge_keep(old, new, "name_norm")
    return ledgers.merge_decisions(kept, human, "name_norm").select("name_norm", "staff_id", "source")


LEDGER_MERGE = V.with_sql("""
SELECT norm AS name_norm, CASE WHEN seq % 5 = 0 THEN 'H' || sid WHEN seq % 3 = 0 THEN sid ELSE 'N' || sid END AS staff_id,
       CASE WHEN seq % 5 = 0 THEN 'human' WHEN seq % 3 = 0 THEN 'old' ELSE 'derived' END AS source
FROM (SELECT norm, arg_max(staff_id, doc_id) AS sid, max(doc_id) AS seq FROM v_roster WHERE norm <> '' GROUP BY 1)""", V.ROSTER)


def bridge_summary(spark, d) -> DataFrame:
    """How many persons with a national id were found and bridged."""
    s = _base(spark, d)
    ids = cut_lineage(roster.name_index(s))
    h = _health_keys(spark, d, s)
    return ledgers.bridge_summary(h, ids, ledgers.derive_bridge(h, ids, roster.latest(s)))


BRIDGE_SUMMARY = V.with_sql(f"""
SELECT count(*) AS n_persons, count(*) FILTER (tkey IN (SELECT tkey FROM v_ids)) AS n_found,
       count(*) FILTER (nid IN (SELECT national_id FROM v_b)) AS n_bridged,
       count(*) FILTER (tkey NOT IN (SELECT tkey FROM v_ids)) AS n_absent
FROM (SELECT nid, arg_min(tkey, doc_id) AS tkey FROM v_health WHERE nid <> '' GROUP BY 1)""",
                            V.ROSTER, V.MENTION, _IDS, _HEALTH, "v_b AS (" + BRIDGE_DERIVE[BRIDGE_DERIVE.index("SELECT nid AS national_id"):] + ")")
