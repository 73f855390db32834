"""Tables in parts: every state is the old one or the new one, whichever step fails."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from footfall.sources import tables
from footfall.sources.parts import PartTable
from footfall.sources.visitors import FirstSeen

SCHEMA = "day date, n int"


def rows(spark, *pairs):
    return spark.createDataFrame([(dt.date(2024, 1, d), n) for d, n in pairs], SCHEMA)


def state(table):
    return sorted((r.day.day, r.n) for r in table.read(schema=SCHEMA).collect())


class Killed(Exception):
    pass


def killed(*_):
    raise Killed


CHANGES = {
    "replace": (lambda t, s: t.replace(rows(s, (2, 20), (3, 30)), ["2024-01-02", "2024-01-03", "2024-01-04"]), [(1, 1), (2, 20), (3, 30)]),
    "append": (lambda t, s: t.append(rows(s, (1, 5), (4, 6)), "w", 2), [(1, 1), (1, 5), (2, 2), (2, 3), (4, 4), (4, 6)]),
    "compact": (lambda t, s: t.compact(lambda r: r.groupBy("day").agg(F.sum("n").cast("int").alias("n"))), [(1, 1), (2, 5), (4, 4)]),
}
OLD = [(1, 1), (2, 2), (2, 3), (4, 4)]


@pytest.mark.parametrize("name", CHANGES)
@pytest.mark.parametrize("step", ["_write", "_names", "_commit", "_publish", "manifest"])
def test_a_failure_at_any_step_leaves_the_old_state(spark, tmp_path, monkeypatch, name, step):
    table = PartTable(spark, f"file://{tmp_path}/t")
    table.append(rows(spark, (1, 1), (2, 2), (4, 4)), "w", 0)
    table.append(rows(spark, (2, 3)), "w", 1)
    change, new = CHANGES[name]
    with monkeypatch.context() as m:
        m.setattr(PartTable, step, killed)
        with pytest.raises(Killed):
            change(PartTable(spark, table.root), spark)
    assert state(table) == OLD
    change(table, spark)  # the next attempt
    assert state(table) == new
    table.vacuum(keep=1, seconds=0)
    assert state(table) == new and len(table._names("data")) == len({v for vs in table.manifest().parts.values() for v in vs})


@pytest.mark.parametrize("method", ["create", "rename"])
def test_a_half_written_manifest_is_not_read(spark, tmp_path, method):
    table = PartTable(spark, f"file://{tmp_path}/t")
    table.append(rows(spark, (1, 1)), "w", 0)
    if method == "create":  # a manifest that was being written
        (tmp_path / "t/manifests/abc.tmp").write_text("{")
    else:  # the number is taken by another writer: this change comes on top of it
        real = table._publish

        def slower(m):
            table._publish = real
            PartTable(spark, table.root).append(rows(spark, (2, 2)), "other", 0)
            return real(m)

        table._publish = slower
    table.append(rows(spark, (1, 3)), "w", 1)
    assert state(table) == [(1, 1), (1, 3)] + ([(2, 2)] if method == "rename" else [])


def test_rows_that_come_while_parts_are_merged_stay(spark, tmp_path):
    table = PartTable(spark, f"file://{tmp_path}/t")
    for i in range(3):
        table.append(rows(spark, (1, 1), (2, i)), "w", i)
    table.replace(rows(spark, (2, 9)), ["2024-01-02"])
    before = table.manifest().parts

    def merge(r):
        PartTable(spark, table.root).append(rows(spark, (1, 100)), "w", 3)
        return r.groupBy("day").agg(F.sum("n").cast("int").alias("n"))

    assert table.compact(merge) == ["2024-01-01"]
    assert state(table) == [(1, 3), (1, 100), (2, 9)]
    assert table.manifest().parts["2024-01-02"] == before["2024-01-02"]  # an untouched part keeps its files


def test_counters_keep_one_mark_a_query_and_the_files_of_quiet_days(spark, tmp_path):
    path, how = f"file://{tmp_path}/c", (["day", "path"], ["hits"])
    schema = "day date, path string, hits bigint"

    def batch(*cells):
        return spark.createDataFrame([(dt.date(2024, 1, d), p, n) for d, p, n in cells], schema)

    want: dict[tuple, int] = {}
    for i in range(40):
        cells = [(1 + i // 8, f"/{i % 3}", i), (1 + i // 8, "/x", 1)]
        for _ in range(1 + i % 2):
            tables.upsert_counters(batch(*cells), path, *how, batch_id=i, query_id="q")
        for d, p, n in cells:
            want[d, p] = want.get((d, p), 0) + n
        if i % 8 == 7:
            quiet = {p: v for p, v in PartTable(spark, path).manifest().parts.items() if len(v) == 1}
            assert tables.compact_counters(spark, path, schema, *how, seconds=0) == [f"2024-01-{1 + i // 8:02d}"]
            now = PartTable(spark, path).manifest()
            assert {p: now.parts[p] for p in quiet} == quiet and now.marks == {"q": i}
    got = {(r.day.day, r.path): r.hits for r in tables.read_counters(spark, path, schema, *how).collect()}
    PartTable(spark, path).vacuum(keep=1, seconds=0)
    assert got == want and len(list((tmp_path / "c/data").glob("v=*"))) == 5
    none = tables.read_counters(spark, f"{path}-none", schema, *how)
    assert none.count() == 0 and none.columns == ["day", "path", "hits"]


def test_first_seen_reads_the_buckets_of_the_runs_visitors(spark, tmp_path):
    def sessions(*cells):
        return spark.createDataFrame([(v, dt.datetime(2024, 1, 1, 0, m)) for v, m in cells], "visitor_key string, started_at timestamp_ntz")

    seen = FirstSeen(spark, f"file://{tmp_path}/v", buckets=8)
    assert seen.lookup(sessions(("a", 1))).count() == 0
    seen.add(sessions(*[(f"v{i}", i % 50) for i in range(200)], (None, 1)), run=0)
    assert not seen.add(sessions(("late", 1)), run=0)
    seen.add(sessions(("v3", 1), ("v4", 50), ("new", 7)), run=1)
    got = {r.visitor_key: r.started_at.minute for r in seen.lookup(sessions(("v3", 9), ("v4", 9), ("new", 9), ("none", 9))).collect()}
    assert got == {"v3": 1, "v4": 4, "new": 7}
    plan = seen.lookup(sessions(("v3", 9)))._jdf.queryExecution().executedPlan().toString()
    assert seen.compact(0) and {r.visitor_key: r.started_at.minute for r in seen.lookup(sessions(("v3", 9), ("v4", 9))).collect()} == {"v3": 1, "v4": 4}
    read = {f.split("bucket=")[1].split("/")[0] for f in seen.table.read([str(r.b) for r in sessions(("v3", 9)).select(seen._bucket().alias("b")).collect()]).inputFiles()}
    assert len(read) == 1 and "FileScan" in plan
