"""Queries against their SQL on tables whose keys come more than once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.plans import catalog

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    sql = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, str(folder)).select(*sql.columns)
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    got, want = key(got.collect()), key(sql.fetchall())
    assert len(got) == len(want) and all(a == pytest.approx(b, abs=2e-6) if isinstance(a, float) else a == b for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_pages_with_one_url(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    again = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1_000_000)
    pages.unionByName(again).write.parquet(f"{tmp_path}/pages.parquet")
    same_as_sql(spark, tmp_path, "wide_rows", "pages")


@pytest.mark.parametrize("frequent", [3, 1 << 17])
def test_documents_with_one_id(spark, tmp_path, monkeypatch, frequent):
    """Keywords, whether few terms' df are known at first or all."""
    from weftline.operators import keywords

    monkeypatch.setattr(keywords, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" the end Ä")))).write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, tmp_path, "tfidf_top5", "documents")
    # what is shuffled is texts, and not their terms
    plan = keywords.doc_terms(spark.read.parquet(f"{tmp_path}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" in plan[: plan.index("Exchange")]


def test_searches_of_documents_with_one_id(spark, tmp_path):
    """An id's rows are one document, whose length is theirs together; a query's terms alone are counted, and a frequent one's
    postings do not meet by term."""
    from weftline.functions import text
    from weftline.operators import search

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("the end of the erings"))).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("advanced_search", "english_index", "english_search"):
        same_as_sql(spark, tmp_path, name, "documents")
    both = spark.read.parquet(f"{tmp_path}/documents.parquet")
    index = search.build_index(both, "doc_id", ["text", "source"], text.ENGLISH)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(index.postings).count("Exchange") == 2  # the texts, and once more by stems
    assert plan(search.build_index(both, "doc_id", ["text", "source"]).postings).count("Exchange") == 1
    some = index.only(["end", "er"])
    assert {r["term"] for r in some.postings.select("term").distinct().collect()} == {"end", "er"}
    assert "BroadcastHashJoin" in plan(search.phrase_scores(some, [[("end", 0)]], {"text": 1.0}))


def test_postings_of_a_segment_are_shuffled_once(spark, tmp_path):
    from weftline.operators.segments import SegmentedIndex

    index = SegmentedIndex(spark, str(tmp_path), "doc_id", ["text"], per_range=4, key_type="bigint")
    docs = spark.createDataFrame([(i, f"word{i % 3} common") for i in range(40)], "doc_id long, text string")
    found = index._found(docs, "s")
    assert found.count() == 40 and found.agg(F.max("r")).first()[0] < 10
    by_term = found.select("r", F.inline("posts")).groupBy("term", "r").agg(F.count("*").alias("n"))
    assert "Exchange" not in by_term._jdf.queryExecution().executedPlan().toString()
    assert by_term.where("term = 'common'").agg(F.sum("n")).first()[0] == 40
