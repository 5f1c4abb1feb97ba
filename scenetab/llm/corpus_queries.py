"""Queries over the operators that gather counts from the whole corpus, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenetab.llm import collocations, neural, search
from scenetab.llm.common import LOWER, UPPER

QUERIES, ORACLES = {}, {}


def op11_search(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = search.search(search.build_index(docs), items, k=50)
    return out.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLES["op11_search"] = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
g AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
t AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t, g GROUP BY t, nd),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * nd) // greatest(l, 1) AS m FROM d, g),
i AS (SELECT DISTINCT item_id, text, unnest(list_distinct({_TERMS})) AS t FROM benchmark),
s AS (SELECT item_id, text, r, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM i JOIN f USING (t) JOIN t USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s JOIN m USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) <= 50"""


def op12_collocations(spark, sf_dir):
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), longest=4, least=30, cover=80, top=2000)


ORACLES["op12_collocations"] = f"""WITH p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) g(k) WHERE len(w) >= k)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
h AS MATERIALIZED (SELECT lang, phrase, k, a, j, array_to_string(w[:j], ' ') AS one, array_to_string(w[j + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
t AS MATERIALIZED (SELECT h.*, f.f AS l FROM h JOIN f ON f.lang = h.lang AND f.phrase = h.one),
s AS (SELECT t.*, f.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (l + f.f) AS BIGINT) AS score FROM t JOIN f ON f.lang = t.lang AND f.phrase = t.two),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(w[s:s + z - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, k - z + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS z FROM c)) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n USING (lang) LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < 80 * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000"""


def op13_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = neural.score(docs, neural.fit(docs.where(neural.split_of() != 2)))
    return out.select("doc_id", (neural.split_of() == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES |= {f.__name__: f for f in (op11_search, op12_collocations, op13_lm_scoring)}
