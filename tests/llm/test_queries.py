"""All queries on odd rows and on empty tables; those with SQL against DuckDB."""

import duckdb
import pytest

import corpus_pipeline
from weftline.llm import registry

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(map(repr, r)) for r in df.select(*sorted(df.columns)).collect()))


def from_duckdb(sql, folder, glob):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{glob}'")
    return db.sql(sql)


def compare(spark, name, folder, glob=""):
    df, want = registry.QUERIES[name](spark, folder), from_duckdb(registry.ORACLES[name], folder, glob)
    order = sorted(want.columns)
    assert sorted(df.columns) == order
    at = [want.columns.index(c) for c in order]
    got = sorted(tuple(r) for r in df.select(*order).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False) for r in [map(str, r)])
    assert got == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    compare(spark, name, SMALL)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n != "pipeline"])
def test_odd_and_empty(spark, sf, name):
    full, empty = sf
    assert registry.QUERIES[name](spark, empty).count() == 0
    again = [rows(registry.QUERIES[name](spark, full)) for _ in range(2)]
    assert again[0] == again[1] and again[0]


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, sf, stage):
    full, empty = sf
    f = corpus_pipeline.STAGES[stage][1]
    for folder in (full, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = f(spark, docs, folder)
        if stage < len(corpus_pipeline.STAGES) - 1:
            assert out.schema == docs.schema or out.columns == docs.columns
        assert out.count() <= 2 * docs.count()


def test_pipeline_against_its_operators(spark):
    """The stages' decisions, recomputed from the operators' own queries on what each stage was given."""
    from pyspark.sql import functions as F

    from weftline.llm import decontaminate, langid, secrets, setjoin
    from weftline.llm.common import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "near duplicates", "decontamination", "secret scan", "segmentation"]
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    out = {}
    for name, f in corpus_pipeline.STAGES:
        out[name] = (docs, written(f(spark, docs, SMALL), "test"))
        docs = out[name][1]
    given, kept = out["language ID"]
    model = langid.train(given)
    assert ids(kept) == ids(langid.identify(given, model, ["doc_id"]).where("accepted"))
    given, kept = out["near duplicates"]
    found = setjoin.near_duplicates(given.withColumn("_row", F.monotonically_increasing_id()).select("_row", "doc_id", "text"))
    assert ids(kept) == sorted({r["component_id"] for r in found.collect()})
    given, kept = out["decontamination"]
    hits = decontaminate.contamination(given.withColumn("_row", F.monotonically_increasing_id()), spark.read.parquet(f"{SMALL}/benchmark.parquet"), ["_row", "doc_id"])
    assert ids(kept) == ids(hits.where("n_hit = 0"))
    given, kept = out["secret scan"]
    assert ids(kept) == ids(given)
    _, spans = secrets.spans_of(kept.select(F.monotonically_increasing_id().alias("_row"), "text"), "text", ["_row"])
    assert spans.where("kind >= 0").count() == 0  # nothing is left to find
    given, last = out["segmentation"]
    assert last.where("NOT round_trip").count() == 0 and last.select("doc_id").distinct().count() == given.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "sample", "ids_crc32").collect())) == sorted(map(tuple, last.select("doc_id", "sample", "ids_crc32").collect()))
