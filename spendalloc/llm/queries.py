"""One query per operator, over the whole of its table, and the SQL twins that DuckDB can run."""

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, filter_audit, id_files, language_mix, packing
from . import license_scan as licenses
from . import line_dedup as lines
from . import quality
from . import set_join, suffix_dedup
from . import token_counts as counts
from .common import read


def op1_token_counts(spark, sf_dir):
    return counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_language_mix(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = language_mix.language_mix(read(spark, sf_dir, "documents"), train=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "mixture")


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents")).drop("kept")


OP3_SUFFIX_DEDUP = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS c, CASE WHEN i + 50 <= n THEN substr(x, 2 * i + 1, 100) END AS w
  FROM (SELECT doc_id, x, n, unnest(range(n)) AS i FROM h)),
m AS (SELECT w, min(doc_id) AS first FROM b WHERE w IS NOT NULL GROUP BY w),
f AS (
  SELECT doc_id, i, c, max(CASE WHEN first < doc_id THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM b LEFT JOIN m USING (w)),
p AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f)
SELECT doc_id, any_value(n) AS n_bytes, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
       count(*) FILTER (gone = 1 AND before = 0) AS n_spans,
       sha256(unhex(coalesce(string_agg(c, '' ORDER BY i) FILTER (gone = 0), ''))) AS kept_sha256
FROM h LEFT JOIN p USING (doc_id) GROUP BY doc_id"""


def op4_id_files(spark, sf_dir):
    return id_files.id_files(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_set_join(spark, sf_dir):
    return set_join.similar_components(read(spark, sf_dir, "documents"), width=4, percent=85)


OP5_SET_JOIN = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (
  SELECT doc_id AS x, doc_id AS y FROM w
  UNION
  SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)"""


def op6_license_scan(spark, sf_dir):
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    return quality.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.best_fit_packing(packing.token_lengths(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark, sf_dir):
    return lines.line_dedup(read(spark, sf_dir, "documents")).drop("text")


OP10_LINE_DEDUP = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (SELECT key AS gone FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (gone IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN r ON key = gone GROUP BY doc_id"""


def op11_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP11_FILTER_AUDIT = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
f AS (
  SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic,
         MAP {'A': len(w) < 200, 'B': 100 * list_unique(w) < 50 * len(w),
              'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': min(doc_id) OVER (PARTITION BY t) < doc_id} AS fails
  FROM w),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x)
  JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM f GROUP BY part, fails),
x AS (
  SELECT part, filter_order, step, n, good, toxic, fails[filter_order[step]] AS now,
         len(list_filter(string_split(filter_order[1:step - 1], ''), lambda y: y <> '' AND fails[y])) > 0 AS before,
         len(list_filter(map_values(fails), lambda y: y)) AS every
  FROM g, s),
r AS (
  SELECT part, filter_order, step, filter_order[step] AS filter,
         coalesce(sum(n) FILTER (NOT now AND NOT before), 0) AS kept,
         coalesce(sum(n) FILTER (now AND NOT before), 0) AS removed,
         coalesce(sum(n) FILTER (now AND before), 0) AS redundant,
         coalesce(sum(n) FILTER (now AND every = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (now AND NOT before), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (now AND NOT before), 0) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r"""


def op12_centroid_clusters(spark, sf_dir):
    found = centroids.centroid_clusters(read(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        centroids.centroid_digest("centroid").alias("centroid_sha256"))


def _op12_sql(rounds: int = 10) -> str:
    """The rounds one after the other: distances to all centroids (d), nearest ones (a), means (c)."""
    assign = """
d{r} AS MATERIALIZED (
  SELECT vec_id, c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS d
  FROM v JOIN c{r} m USING (i) GROUP BY vec_id, c),
a{r} AS MATERIALIZED (
  SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
    means = """
s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY c, i),
c{n} AS MATERIALIZED (
  SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{r} LEFT JOIN s{r} USING (c, i))"""
    steps = ",".join(assign.format(r=r) + "," + means.format(r=r, n=r + 1) for r in range(rounds))
    return f"""
WITH k AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (
  SELECT vec_id, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM k)),
h AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM k QUALIFY c < 8),
c0 AS MATERIALIZED (SELECT c, i, x FROM h JOIN v USING (vec_id)),{steps},{assign.format(r=rounds)},
m AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       centroid_sha256
FROM a{rounds} JOIN m USING (c)"""


OP12_CENTROID_CLUSTERS = _op12_sql()


def op13_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = bpe.bpe_decode(bpe.bpe_encode(read(spark, sf_dir, "documents"), path), path)
    return whole.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_language_mix, op3_suffix_dedup, op4_id_files, op5_set_join, op6_license_scan,
    op7_best_fit_packing, op8_quality_rules, op9_decontaminate, op10_line_dedup, op11_filter_audit,
    op12_centroid_clusters, op13_bpe)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
