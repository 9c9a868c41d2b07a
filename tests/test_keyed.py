import random

import pytest
from pyspark.sql import functions as F

from weftline.sources import keyed, sinks


def rows_of(spark, d):
    return spark.createDataFrame(list(d.items()), "k string, v int")


def test_merges_and_reads(spark, tmp_path):
    draw = random.Random(2)
    table, want = keyed.KeyedTable(spark, str(tmp_path), "k", rows_per_file=50), {}
    assert table.read().collect() == [] and table.get("x").collect() == []
    names = [f"{i:04x}" for i in range(3000)] + ["", "é", "中", "\U0001f600"]
    for n in (400, 5, 300):
        batch = {draw.choice(names): draw.randrange(1000) for _ in range(n)}
        table.upsert(rows_of(spark, batch))
        want |= batch
        entries = table.entries()
        assert {r["k"]: r["v"] for r in table.read().collect()} == want and sum(e["rows"] for e in entries) == len(want)
        # shares follow each other, and a file's keys lie in its own
        assert entries[0]["lower"] is None
        for a, b in zip(entries, entries[1:], strict=False):
            assert a["most"] < b["lower"] <= b["least"]
    for start, stop in (("01", "02"), (None, "0040"), ("0b", None), ("zz", "zzz"), ("é", None)):
        got = {r["k"]: r["v"] for r in table.range(start, stop).collect()}
        assert got == {k: v for k, v in want.items() if (start is None or k >= start) and (stop is None or k < stop)}
    some = draw.sample(names, 40)
    assert {r["k"]: r["v"] for r in table.get(*some).collect()} == {k: want[k] for k in some if k in want}


def test_files_are_pruned_and_kept(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path), "k", rows_per_file=100)
    table.upsert(spark.range(2000).select(F.format_string("%05d", "id").alias("k"), F.col("id").cast("int").alias("v")))
    before = table.entries()
    assert len(before) >= 10
    # a range and a point open few files; the plan lists no others
    assert len(table.overlapping("00700", "00710")) <= 2 and len(table.range("00700", "00710").inputFiles()) <= 2
    assert len(table.get("00701").inputFiles()) == 1 and table.get("00701").first()["v"] == 701
    plan = table.range("00700", "00710")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), GreaterThanOrEqual(k,00700), LessThan(k,00710)]" in plan
    # a merge rewrites the files it touches and no others
    table.upsert(spark.createDataFrame([("00701", -1), ("00701", -2), ("00702x", 7)], "k string, v int"))
    after = table.entries()
    assert len({e["file"] for e in before} - {e["file"] for e in after}) == 1
    assert [r["v"] for r in table.range("00700", "00704").orderBy("k").collect()] == [700, -1, 702, 7, 703]
    table.vacuum(keep=1, older_than_ms=-1000)
    assert table.read().count() == 2001 and table.versions.last() == 1 and len(table.versions.folder.names()) == 1


class Stop(Exception):
    pass


def test_a_stop_at_any_step_loses_nothing(spark, tmp_path, monkeypatch):
    """Every write, rename and deletion of a merge fails in turn; the table has the old rows or the new ones, and the
    same merge works afterwards."""
    real = {name: getattr(keyed.Folder, name) for name in ("rename", "delete")}
    commit = keyed.Versions.commit
    steps = [("before the manifest", "commit"), ("before the rename", "rename"), ("after the rename", "after")]
    table, want = keyed.KeyedTable(spark, str(tmp_path), "k", rows_per_file=10), {}
    table.upsert(rows_of(spark, want := {f"{i:02d}": i for i in range(40)}))
    for n, (_, step) in enumerate(steps):
        batch = {f"{i:02d}": 100 * n + i for i in range(5, 60, 7)}

        def stopped(self, *a, step=step):
            if step == "after":
                (commit if isinstance(self, keyed.Versions) else real["rename"])(self, *a)
            raise Stop

        with monkeypatch.context() as m:
            m.setattr(keyed.Versions if step == "commit" else keyed.Folder, "commit" if step == "commit" else "rename", stopped)
            with pytest.raises(Stop):
                table.upsert(rows_of(spark, batch))
        got = {r["k"]: r["v"] for r in table.read().collect()}
        assert got == (want | batch if step == "after" else want)
        table.upsert(rows_of(spark, batch))
        want |= batch
        assert {r["k"]: r["v"] for r in table.read().collect()} == want


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another merge commits while one is at work: the one starts again and loses neither's rows."""
    table = keyed.KeyedTable(spark, str(tmp_path), "k")
    table.upsert(rows_of(spark, {"a": 1}))
    commit, other = keyed.Versions.commit, []

    def late(self, rows, version):
        if not other:
            other.append(1)
            keyed.KeyedTable(spark, str(tmp_path), "k")._merge(rows_of(spark, {"b": 2}))
        commit(self, rows, version)

    monkeypatch.setattr(keyed.Versions, "commit", late)
    assert table.upsert(rows_of(spark, {"c": 3, "a": 4})) == 2
    assert {r["k"]: r["v"] for r in table.read().collect()} == {"a": 4, "b": 2, "c": 3}


def test_odd_batches(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path), "k")
    assert table.upsert(rows_of(spark, {"a": 1}).limit(0)) == -1
    table.upsert(rows_of(spark, {"a": 1}))
    with pytest.raises(Exception, match="k is null"):
        table.upsert(rows_of(spark, {None: 1}))
    table.upsert(spark.createDataFrame([("b", 2, "new")], "k string, v int, w string"))
    assert {tuple(r) for r in table.read().select("k", "v", "w").collect()} == {("a", 1, None), ("b", 2, "new")}


def test_upsert_after_a_stop_between_its_renames(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame([(i, i) for i in x], "k int, v int")
    sinks.upsert(rows(1, 2), path, ["k"])
    (tmp_path / "t").rename(tmp_path / "t.old")
    sinks.upsert(rows(3), path, ["k"])
    sinks.upsert(rows(4), path, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
