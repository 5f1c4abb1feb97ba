"""Queries over the operators made of columns only, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenetab.llm import decontamination, lines, mixing, sharding
from scenetab.llm.common import LOWER, UPPER
from scenetab.llm.mixing import MASK, SEEDS

QUERIES, ORACLES = {}, {}

WEIGHTS = [5.0, 2.0, 1.0]
SHARDS = 24


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark, sf_dir):
    out = lines.line_dedup(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_KEY = f"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}')"
ORACLES["op1_line_dedup"] = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, p, ls[p] AS line FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS p FROM d)),
k AS (SELECT r, p, line, {_KEY} AS k FROM l),
bad AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, len(ls) AS n_lines, count(*) FILTER (WHERE bad.k IS NOT NULL) AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE bad.k IS NULL), '')) AS kept_sha256
FROM d JOIN k USING (r) LEFT JOIN bad ON k.k = bad.k GROUP BY r, doc_id, ls"""


def op4_mixing(spark, sf_dir):
    return mixing.mix_sizes(documents(spark, sf_dir), WEIGHTS).select("doc_id", "size", "source_size", "target", "taken", "copies")


_HEX = "CAST('0x' || substr(m, {}, 13) AS BIGINT)"
ORACLES["op4_mixing"] = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))) AS m FROM documents),
u AS (SELECT doc_id, source, size, {_HEX.format(1)} AS a, {_HEX.format(14)} AS b FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS w,
row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM u GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(3 AS DOUBLE) * n / w, nth) AS k FROM s),
v AS (SELECT *, (sum(n) OVER () - CAST(3 AS DOUBLE) * coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
/ sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM o),
e AS (SELECT lev, k AS from_k FROM v WHERE lev * w <= CAST(3 AS DOUBLE) * n ORDER BY k LIMIT 1),
t AS (SELECT source, n, CASE WHEN from_k IS NULL OR k < from_k THEN CAST(3 AS DOUBLE) * n ELSE least(e.lev * w, CAST(3 AS DOUBLE) * n) END AS target FROM v LEFT JOIN e ON true),
r AS (SELECT source, n, target, floor(CASE WHEN n > 0 THEN target / n ELSE 0 END) AS base, CASE WHEN n > 0 THEN target / n ELSE 0 END - floor(CASE WHEN n > 0 THEN target / n ELSE 0 END) AS frac FROM t),
c AS (SELECT u.source, k, sum(size * least(base + CASE WHEN ((a + b * k) % {MASK + 1}) / CAST({MASK + 1} AS DOUBLE) < frac THEN 1 ELSE 0 END, 3)) AS got
FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source, range({SEEDS}) AS seeds(k) GROUP BY u.source, k),
p AS (SELECT r.source, n, target, base, frac, k FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source QUALIFY row_number() OVER (PARTITION BY r.source ORDER BY abs(got - target), k) = 1)
SELECT doc_id, size, n AS source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM (
SELECT doc_id, size, n, target, least(base + CASE WHEN ((a + b * k) % {MASK + 1}) / CAST({MASK + 1} AS DOUBLE) < frac THEN 1 ELSE 0 END, 3) AS copies
FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source)"""


def op8_decontamination(spark, sf_dir):
    out = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_W = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"
ORACLES["op8_decontamination"] = f"""WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_W} FROM documents), iw AS (SELECT item_id, {_W} FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0)),
g AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
h AS (SELECT r, p, n, item_id FROM g JOIN win USING (n, k)),
hp AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM dw LEFT JOIN hp USING (r) LEFT JOIN hi USING (r)"""


def op10_sharding(spark, sf_dir):
    return sharding.assign_shards(documents(spark, sf_dir), [1.0] * SHARDS).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


# the checksum goes byte by byte through a table made from its polynomial
ORACLES["op10_sharding"] = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
tab AS (SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) g(i)),
b AS (SELECT r, list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS bs FROM d),
c AS (SELECT r, xor(list_reduce(bs, lambda c, x: xor(c >> 8, tab[xor(c, x) % 256 + 1])), CAST(4294967295 AS BIGINT)) AS crc FROM b, tab),
w AS (SELECT r, CAST(s AS INT) AS s, -ln((CAST(CAST('0x' || substr(md5(k || ':' || s), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / CAST({1 << 52} AS DOUBLE)) AS wait FROM d, range({SHARDS + 1}) g(s)),
own AS (SELECT r, s AS shard FROM w WHERE s < {SHARDS} QUALIFY row_number() OVER (PARTITION BY r ORDER BY wait, s) = 1),
grown AS (SELECT r, s AS grown_shard FROM w QUALIFY row_number() OVER (PARTITION BY r ORDER BY wait, s) = 1),
a AS (SELECT doc_id, CAST(strlen(t) + 8 AS BIGINT) AS size, crc, shard, grown_shard, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), t)), 1, 13) AS BIGINT) AS place
FROM d JOIN c USING (r) JOIN own USING (r) JOIN grown USING (r))
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, crc, size) - 1 AS slot, grown_shard FROM a"""


QUERIES |= {f.__name__: f for f in (op1_line_dedup, op4_mixing, op8_decontamination, op10_sharding)}
