"""Queries over the operators that run Python inside tasks."""

from __future__ import annotations


from pyspark.sql import functions as F

from scenetab.llm import chunks, jaccard, langid, quality, substrings, warc
from scenetab.llm.common import LOWER, UPPER

QUERIES, ORACLES = {}, {}


def op2_suffix_dedup(spark, sf_dir):
    out = substrings.substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_chunk_dedup(spark, sf_dir):
    """With chunks fine enough for a passage of some 50 words to hold a chain of them wherever it stands."""
    out = chunks.chunk_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=16, bits=4, chain=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_warc(spark, sf_dir):
    out = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INT), 1)), '')"
ORACLES["op5_warc"] = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {_B32} AS payload_digest,
CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to FROM f"""


def op6_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = langid.identify(docs, langid.fit_on_split(docs))
    return out.select("doc_id", (langid.split_of() == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_jaccard_join(spark, sf_dir):
    out = jaccard.classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


ORACLES["op7_jaccard_join"] = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p:p + 2], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 9 GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * c >= 90 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT g.b, r.c FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) g ON g.a = r.a)
SELECT doc_id, len(s) AS n_shingles, c.c AS component_id FROM s JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) c ON c.a = s.doc_id"""


def op9_quality(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, quality.fit(docs, labels))


QUERIES |= {f.__name__: f for f in (op2_suffix_dedup, op3_chunk_dedup, op5_warc, op6_langid, op7_jaccard_join, op9_quality)}
