"""Queries over whole tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm import ann, bin_slack, language_id, mixing, packing, periodic, prefix_trie, quality, simhash, suffix_dedup, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "switches")


def op2_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_srs_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op5_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "spans")


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
r AS (SELECT *, payload_bytes >= 100 AND coalesce(page_id > first, false) AS again FROM m)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM r
"""


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


#: Target entropy (share of the largest), most repetitions of a source, blocks and seed of op8.
MIX_ENTROPY, MIX_REPEATS = 0.95, 4.0


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(_table(spark, sf_dir, "documents"), MIX_ENTROPY, MIX_REPEATS)
    return out.select("doc_id", "source", "n_tokens", "weight", "copies")


OP8_SQL = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS k, md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x09-\\x0D\\x20]+')), 0) AS BIGINT) AS n
  FROM documents),
d AS (SELECT *, CAST(('0x' || substr(o, 1, 8)) AS BIGINT) % (SELECT greatest({mixing.BLOCKS}, (count(*) + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS}) FROM documents) AS b FROM t),
s AS (SELECT k, sum(n)::BIGINT AS n FROM d GROUP BY k),
tot AS (SELECT sum(n)::BIGINT AS n FROM s),
top AS (SELECT max(n)::DOUBLE AS top FROM s),
lp AS (SELECT ln(s.n / tot.n::DOUBLE) AS lp, ln(s.n / tot.n::DOUBLE) - max(ln(s.n / tot.n::DOUBLE)) OVER () AS d, count(*) OVER () AS cnt FROM s, tot WHERE s.n > 0),
g AS (
  SELECT a, ln(sum(exp(a * d))) - sum(exp(a * d) * a * d) / sum(exp(a * d)) - {MIX_ENTROPY} * ln(max(cnt)) AS above, max(exp(a * d - lp)) / sum(exp(a * d)) <= {MIX_REPEATS} * (1 + 1e-12) AS fits
  FROM (SELECT 2.0::DOUBLE ** k AS a FROM range(0, {mixing.DOUBLINGS} + 1) x(k)), lp GROUP BY a),
one AS (SELECT above > 0 AS sharp, fits, (SELECT min(a) FROM g WHERE a > 1 AND (above < 0 OR NOT fits)) AS high FROM g WHERE a = 1),
st AS (SELECT sharp, CASE WHEN NOT fits OR (sharp AND high IS NULL) THEN 1::DOUBLE WHEN sharp THEN high / 2 ELSE 0 END AS lo, CASE WHEN NOT fits OR (sharp AND high IS NULL) THEN 1::DOUBLE WHEN sharp THEN high ELSE 1 END AS hi FROM one),
bi AS (
  SELECT 0 AS i, sharp, lo, hi FROM st
  UNION ALL
  SELECT i + 1, sharp, CASE WHEN sharp = good THEN mid ELSE lo END, CASE WHEN sharp = good THEN hi ELSE mid END
  FROM (SELECT i, sharp, lo, hi, (lo + hi) / 2 AS mid,
        (SELECT CASE WHEN sharp THEN 1 ELSE -1 END * (ln(sum(exp((lo + hi) / 2 * d))) - sum(exp((lo + hi) / 2 * d) * (lo + hi) / 2 * d) / sum(exp((lo + hi) / 2 * d)) - {MIX_ENTROPY} * ln(max(cnt))) >= 0
            AND max(exp((lo + hi) / 2 * d - lp)) / sum(exp((lo + hi) / 2 * d)) <= {MIX_REPEATS} * (1 + 1e-12) FROM lp) AS good
        FROM bi WHERE i < {mixing.STEPS * mixing.PASSES})),
a AS (SELECT CASE WHEN sharp THEN lo ELSE hi END AS a FROM bi WHERE i = {mixing.STEPS * mixing.PASSES}),
p AS (SELECT k, s.n AS al, CASE WHEN s.n > 0 THEN exp(a * ln(s.n / top)) ELSE 0 END AS p FROM s, top, a),
q AS (SELECT k, al, p / (SELECT sum(p) FROM p) AS w, CAST(floor(round(tot.n::DOUBLE * (p / (SELECT sum(p) FROM p)), 3)) AS BIGINT) AS quota FROM p, tot),
e AS (SELECT k, round(w, 9) AS w, CASE WHEN al > 0 THEN quota // al ELSE 0 END AS ep, CASE WHEN al > 0 THEN quota % al ELSE 0 END AS rest FROM q),
pb AS (SELECT k, b, sum(n)::BIGINT AS n FROM d GROUP BY k, b),
gr AS (SELECT k, b // {mixing.BLOCKS} AS gb, sum(n)::BIGINT AS gn FROM pb GROUP BY ALL),
gs AS (SELECT k, gb, sum(gn) OVER (PARTITION BY k ORDER BY md5('1:' || k || ':group:' || gb), gb) - gn AS before FROM gr),
c AS (SELECT k, pb.b, w, ep, pb.n, rest - before - (sum(pb.n) OVER (PARTITION BY k, gb ORDER BY md5('1:' || k || ':' || pb.b), pb.b) - pb.n) AS room FROM pb JOIN e USING (k) JOIN gs USING (k) WHERE gs.gb = pb.b // {mixing.BLOCKS}),
r AS (SELECT d.*, c.w, c.ep, c.room, c.n AS bn, sum(d.n) OVER (PARTITION BY d.k, d.b ORDER BY d.o) AS cum FROM d JOIN c ON d.k = c.k AND d.b = c.b)
SELECT doc_id, source, n AS n_tokens, w AS weight,
       CAST(ep + CASE WHEN room > 0 AND (room >= bn OR cum <= room) THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM r
"""


def op9_suffix_dc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_bmw_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0, 10)


OP10_SQL = """
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z]|[^\\x00-\\x7F])+')) AS t
  FROM documents),
p AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM w GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY doc_id),
n AS (SELECT count(*)::DOUBLE AS n, (SELECT sum(len) FROM l) / count(*) AS mean FROM documents),
d AS (SELECT t, ln(1 + (n.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, n GROUP BY t, n.n),
s AS (
  SELECT q.doc_id AS query_id, p.doc_id, round(sum(d.idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.len / n.mean))), 6) AS score
  FROM p q JOIN p ON q.t = p.t JOIN d ON d.t = p.t JOIN l ON l.doc_id = p.doc_id, n
  WHERE q.doc_id % 20 = 0 AND q.doc_id <> p.doc_id
  GROUP BY q.doc_id, p.doc_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


def op11_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bin_slack.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op12_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(periodic.plant(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = found.withColumn("best", periodic.longest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.sequences(_table(spark, sf_dir, "conversations"))))


OP13_SQL = """
WITH t AS (
  SELECT conv_id AS c, turn, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS d,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS k FROM t),
bits AS (SELECT c, flatten(list_transform(range(1, CAST(length(c::VARCHAR) AS BIGINT) + 1), lambda i: list_concat([ascii(substr(c::VARCHAR, CAST(i AS INTEGER), 1))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]))) AS s FROM (SELECT DISTINCT c FROM k)),
h AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], s), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h FROM bits),
r AS (
  SELECT h.c, k.k, k.d, k.w FROM h JOIN k ON k.c = h.c - h.c % 20 AND k.k <= h.h
  UNION ALL
  SELECT h.c, k.k, k.d, k.w FROM h JOIN k ON k.c = h.c AND k.k > h.h),
q AS (SELECT h.c, coalesce(list(r.d ORDER BY r.k) FILTER (r.k IS NOT NULL), []) AS ds, coalesce(list(r.w ORDER BY r.k) FILTER (r.k IS NOT NULL), []) AS ws FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
p AS (SELECT c, ds, ws, unnest(range(0, len(ds) + 1)) AS depth FROM q),
n AS (
  SELECT depth, array_to_string(list_slice(ds, 1, depth), '') AS path, min(c) AS conv_id, count(*) AS n_convs, coalesce(max(ws[depth]), 0) AS w,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ds) = depth), '')) AS ends_sha256
  FROM p GROUP BY 1, 2),
u AS (SELECT m.depth, m.path, count(k.path) AS n_children FROM n m LEFT JOIN n k ON k.depth = m.depth + 1 AND substr(k.path, 1, 32 * m.depth) = m.path GROUP BY 1, 2),
a AS (
  SELECT substr(path, 1, 32 * up) AS path, up AS depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT n.path, unnest(range(0, n.depth + 1)) AS up, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * w AS saved FROM n JOIN u ON u.depth = n.depth AND u.path = n.path)
  GROUP BY 1, 2)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, u.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN u ON u.depth = n.depth AND u.path = n.path JOIN a ON a.depth = n.depth AND a.path = n.path
LEFT JOIN n m ON m.depth = n.depth - 1 AND m.path = substr(n.path, 1, 32 * m.depth)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_crf": op1_language_crf,
    "op2_simhash_bktree": op2_simhash_bktree,
    "op3_pow2_packing": op3_pow2_packing,
    "op4_srs_ann": op4_srs_ann,
    "op5_toxic_crf": op5_toxic_crf,
    "op6_arc_to_warc": op6_arc_to_warc,
    "op7_quality_qda": op7_quality_qda,
    "op8_temperature_mix": op8_temperature_mix,
    "op9_suffix_dc3": op9_suffix_dc3,
    "op10_bmw_bm25": op10_bmw_bm25,
    "op11_bin_slack": op11_bin_slack,
    "op12_harmonic_runs": op12_harmonic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op6_arc_to_warc": OP6_SQL, "op8_temperature_mix": OP8_SQL, "op10_bmw_bm25": OP10_SQL, "op13_prefix_trie": OP13_SQL}
