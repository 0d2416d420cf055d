"""The queries of the ten operators over their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, language_id, license_scan, mixing, packing, simhash_dedup, suffix_dedup, token_binary, toxicity
from .common import table


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = license_scan.scan(docs.select("doc_id", path.alias("path"), "text"))
    return found.select("doc_id", "path", "licence", F.round("cosine", 4).alias("cosine"), "origin", "from_path")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_links(table(spark, sf_dir, "embeddings"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.binary_round_trip(table(spark, sf_dir, "documents"), byte_bpe())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_license_scan, op3_embedding_near_dedup, op4_simhash_near_dedup, op5_token_binary,
        op6_language_id, op7_source_mixing, op8_toxicity, op9_exact_dedup, op10_suffix_dedup,
    )
}


def _licence_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b) in enumerate(license_scan.TEMPLATES))
    n, term, name = len(license_scan.TEMPLATES), quoted(license_scan.TERM), quoted(license_scan.FILE_NAME)
    comment, end, line_end = quoted(license_scan.COMMENT), quoted(license_scan.COMMENT_END), quoted(license_scan.LINE_END)
    return f"""
WITH templates(t, licence, body) AS (VALUES {templates}),
ttf AS (SELECT t, licence, term, count(*) AS tf FROM (SELECT t, licence, unnest(regexp_extract_all(lower(body), {term})) AS term FROM templates) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + {n}) / (1.0 + count(*))) + 1.0 AS idf FROM ttf GROUP BY term),
tw AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY t)) AS norm FROM (SELECT t, licence, term, (ln(tf) + 1.0) * idf AS w FROM ttf JOIN idf USING (term))),
files AS (SELECT doc_id, concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), doc_id::VARCHAR || '.txt') AS path, coalesce(text, '') AS text FROM documents),
lines AS (SELECT path, string_split_regex(text, {line_end}) AS raw FROM files WHERE path IS NOT NULL),
bare AS (
  SELECT path, raw, list_transform(raw, lambda x: regexp_replace(regexp_replace(x, {comment}, ''), {end}, '')) AS line,
    list_position(list_transform(raw, lambda x: regexp_matches(x, {comment}) OR regexp_matches(x, '^[\\x20\\t]*$')), false) AS code FROM lines),
texts AS (
  SELECT path, array_to_string(line, chr(10)) AS text, array_to_string(line, ' ') AS joined,
    CASE WHEN code = 1 THEN '' WHEN code > 1 THEN array_to_string(line[1:code - 1], ' ') ELSE array_to_string(line, ' ') END AS head FROM bare),
units AS (
  SELECT DISTINCT path, unnest(list_concat(string_split_regex(text, '\\n+'), string_split_regex(text, '\\n\\n+'),
    string_split(regexp_replace(replace(regexp_replace(text, '\\n\\n+', chr(1), 'g'), chr(10), ' '), '([.!?;:]) +', '\\1' || chr(1), 'g'), chr(1)), [head], CASE WHEN regexp_matches(path, {name}) THEN [joined] ELSE []::VARCHAR[] END)) AS unit FROM texts),
utf AS (SELECT path, unit, term, count(*) AS n FROM (SELECT path, unit, unnest(regexp_extract_all(lower(unit), {term})) AS term FROM units) GROUP BY ALL),
uw AS (SELECT u.*, (ln(u.n) + 1.0) * coalesce(i.idf, ln(1.0 + {n}) + 1.0) AS x FROM utf u LEFT JOIN idf i USING (term)),
unorm AS (SELECT path, unit, sqrt(sum(x * x)) AS length FROM uw GROUP BY ALL),
dots AS (SELECT path, unit, t, licence, sum(x * w / norm) AS dot FROM uw JOIN tw USING (term) GROUP BY ALL),
best AS (
  SELECT path, licence, cosine FROM (SELECT path, licence, round(dot / length, 6) AS cosine FROM dots JOIN unorm USING (path, unit)) WHERE cosine >= {license_scan.LEAST}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, licence) = 1),
dirs AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, licence, cosine, path FROM best WHERE regexp_matches(path, {name})
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY cosine DESC, path) = 1),
inherited AS (
  SELECT f.path, d.licence, d.cosine, d.path AS from_path FROM files f JOIN dirs d ON d.dir = '' OR starts_with(f.path, d.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(d.dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(b.licence, i.licence) AS licence, round(coalesce(b.cosine, i.cosine), 4) AS cosine,
  CASE WHEN b.path IS NOT NULL THEN 'own' WHEN i.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN b.path IS NOT NULL THEN f.path ELSE i.from_path END AS from_path
FROM files f LEFT JOIN best b ON b.path = f.path LEFT JOIN inherited i ON i.path = f.path"""


_EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS m FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""

_EXACT_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""

_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix' || doc_id::VARCHAR) AS m FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM r),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS fill FROM f),
p AS (SELECT source, source_size, rank, total, least(cap, coalesce(fill * weight, cap)) AS target FROM g),
q AS (SELECT d.*, p.source_size, p.rank, p.total, p.target, sum(d.size) OVER (PARTITION BY p.rank ORDER BY m, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS done FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
i AS (SELECT doc_id, m, size, rank, total, x.pass AS pass, (done + source_size * x.pass) / target AS time FROM q, (VALUES (0), (1)) x(pass) WHERE size > 0 AND target > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY time, rank, m, doc_id, pass, size ROWS UNBOUNDED PRECEDING) AS upto FROM i),
t AS (SELECT doc_id, m, sum(size)::BIGINT AS taken FROM c WHERE upto <= floor(total) GROUP BY doc_id, m)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken FROM q LEFT JOIN t ON t.doc_id = q.doc_id"""

_REPEATS_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, s, substring(x, 2 * s + 1, 400) AS piece FROM (SELECT r, x, unnest(range(0, greatest(len(x) // 2 - 199, 0))) AS s FROM d)),
twice AS (SELECT p.r AS r, p.s AS s FROM (SELECT unnest(places) AS p FROM (SELECT list({'r': r, 's': s}) AS places FROM w GROUP BY piece HAVING count(*) > 1))),
starts AS (SELECT r, s, sum(CASE WHEN s <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS run FROM (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM twice)),
runs AS (SELECT r, min(s) AS a, max(s) + 200 AS z FROM starts GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z FROM runs UNION ALL SELECT r, max(z), 1000000000 FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(substring(x, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS left_over FROM gaps JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_over, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN sums USING (r)"""

SQL: dict[str, str] = {
    "op2_license_scan": _licence_sql(),
    "op3_embedding_near_dedup": _EMBEDDING_SQL,
    "op7_source_mixing": _MIX_SQL,
    "op9_exact_dedup": _EXACT_SQL,
    "op10_suffix_dedup": _REPEATS_SQL,
}
