"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import corpus_pipeline
import duckdb
import plain
import pytest
from conftest import SF
from odd_tables import none, odd, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from scenetab.llm import langid
from scenetab.llm.common import stored
from scenetab.llm.native_queries import ORACLES


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_are_their_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    language, near, clean, mix, shard = [f for _, f in corpus_pipeline.STAGES]

    table = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    after = stored(language(spark, docs, SF), "test")
    assert ids(after) == Counter(i for (i, _, _), (lang, _, doubt) in zip(table, plain.languages(table)) if lang != "und" and not doubt)
    assert after.count() >= 0.99 * len(table)

    table = [(r["doc_id"], r["text"]) for r in after.collect()]
    classes = plain.components(table, 5, 80)
    least = {c: min(i for (i, _), d in zip(table, classes) if d == c) for c in classes}
    docs, after = after, stored(near(spark, after, SF), "test")
    assert ids(after) == Counter(i for (i, _), c in zip(table, classes) if c is None or least[c] == i)
    assert after.count() < docs.count()

    table = [(r["doc_id"], r["text"]) for r in after.collect()]
    docs, after = after, stored(clean(spark, after, SF), "test")
    assert ids(after) == Counter(i for i, t in table if not plain.contaminated(t, items))
    assert after.count() < docs.count()

    path = str(tmp_path / "documents")
    after.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    # the same query and draws as op4, over this stage's input
    copies = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, copies FROM ({ORACLES['op4_mixing']})").fetchall() if r[1]}
    docs, after = after, stored(mix(spark, after, SF), "test")
    assert ids(after) == Counter(copies)

    last = shard(spark, after, SF)
    assert last.columns == [*columns, "shard"] and after.columns == columns
    assert Counter((r["doc_id"], r["shard"]) for r in last.collect()) == Counter({(i, plain.shard(i, 24)): n for i, n in copies.items()})
    assert last.select(*columns).exceptAll(after).isEmpty()


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test")
    whole = corpus_pipeline.run(spark, SF)
    assert whole.exceptAll(docs).isEmpty() and whole.count() == docs.count()


def test_stages_bear_odd_rows(spark, odd, none):
    for table in (odd, none):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), "test")
        assert docs.count() <= 3 * table.count()


@pytest.mark.parametrize("k", range(5))
def test_columns_of_any_name_are_kept(spark, odd, k):
    """Each stage keeps columns that are named like those inside the operators, with their values."""
    clash = odd.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in ("_row", "_k1", "id", "row", "token", "_id", "_text", "taken")})
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, clash, SF)
    assert set(got.columns) == set(clash.columns) and got.where("NOT startswith(_row, '_row:')").isEmpty()
    assert Counter(map(tuple, got.select(*[c for c in odd.columns if c != "shard"]).collect())) == Counter(map(tuple, stage(spark, odd, SF).select(*[c for c in odd.columns if c != "shard"]).collect()))


def test_languages_are_those_of_the_plain_version(spark, odd, odd_rows):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        table = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
        want = Counter((i, lang, round(score, 3)) for (i, _, _), (lang, score, _) in zip(table, plain.languages(table)))
        got = langid.identify(docs, langid.fit_on_split(docs)).collect()
        assert Counter((r["doc_id"], r["lang_pred"]) for r in got) == Counter((i, lang) for i, lang, _ in want.elements())
        score = {i: s for i, _, s in want if sum(n for w, n in want.items() if w[0] == i) == 1}
        assert all(abs(r["score"] - score[r["doc_id"]]) < 2e-3 for r in got if r["doc_id"] in score)


def test_texts_beyond_a_piece_count_as_a_whole(spark):
    """Some 3 MB: mostly one language at the head, more of the other behind it."""
    one, two = "".join(f"tha{k % 7}ing " for k in range(3000)), "".join(f"que{k % 7}ción " for k in range(3000))
    small = [(k, (one, two)[k % 2][100 * k : 100 * k + 900], ("a", "b")[k % 2]) for k in range(60)]
    big = [(100, one * 30 + two * 70, None), (101, two * 30 + one * 70, None)]
    docs = spark.createDataFrame(small + big, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fit_on_split(docs)).collect()}
    assert len(big[0][1]) > langid.PIECE and (got[100], got[101]) == ("b", "a")
