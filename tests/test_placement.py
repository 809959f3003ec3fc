"""Positions of null and repeated keys, weighted choice from a table, exact selection, logging
intervals, margins, and run tables that are appended to again after a failure."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marksmith.functions.keyed import hash60, unit_draw
from marksmith.operators import audit, pairing, runs, sampling
from marksmith.operators.position import with_position_by_key
from marksmith.operators.ranges import last_mark
from marksmith.sources import sinks


def test_every_row_keeps_one_position(spark):
    rows = [(3, "c"), (None, "n"), (1, "a"), (3, "c2"), (3, "c3"), (None, "n2")]
    for some in (rows, rows[:3], rows[:2]):
        df = spark.createDataFrame(some, "k long, v string").repartition(3)
        got = with_position_by_key(df, ["k"]).collect()
        assert sorted(r.pos for r in got) == list(range(len(some)))
        assert sorted(r.v for r in got) == sorted(v for _, v in some)
        by_pos = [r.k for r in sorted(got, key=lambda r: r.pos)]
        assert by_pos == sorted((k for k, _ in some), key=lambda k: (k is not None, k or 0))


def test_registry_of_repeated_and_null_keys(spark):
    rows = [(1, "k a", "r one"), (1, "k b", "r two"), (None, "k c", "r three")]
    reg = pairing.assemble_registry(spark.createDataFrame(rows, "id long, key string, response string"),
                                    order=["id"]).collect()
    assert sorted(r.fp_id for r in reg) == [0, 1, 2] and {r.key for r in reg} == {"k a", "k b", "k c"}


def test_last_mark_equals_a_scan(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        marks = sorted({round(rnd.uniform(0, 9), 1) for _ in range(rnd.choice([0, 1, 30]))})
        # a third of the points on one value
        points = [(i, 4.5 if i % 3 == 0 else round(rnd.uniform(-1, 10), 1)) for i in range(300)]
        df = spark.createDataFrame(points, "i int, p double")
        m = spark.createDataFrame([(x, f"m{x}") for x in marks], "x double, name string")
        got = last_mark(df, F.col("p"), m, F.col("x"), F.col("name"), "near", num_partitions=7).collect()
        want = {(i, p, max((x for x in marks if x <= p), default=None)) for i, p in points}
        assert {(r.i, r.p, r.near and float(r.near[1:])) for r in got} == want and len(got) == 300


def test_choice_from_many_weights(spark):
    n = 20_000
    weights = spark.range(n).select(F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"),
                                    (F.col("id") % 7).cast("double").alias("weight"))
    weights = weights.unionByName(spark.createDataFrame([("w000001", 50_000.0), (None, 9.0), ("x", None)],
                                                        "name string, weight double"))
    df = spark.range(3000)
    drawn = sampling.weighted_choice_from(df, weights, F.col("id"), 5)
    assert "array(" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    table = defaultdict(float)
    for i in range(n):
        table[f"w{i:06d}"] += i % 7
    table["w000001"] += 50_000
    total, at, ends = sum(table.values()), 0.0, []
    for name in sorted(k for k, w in table.items() if w):
        ends.append((at, name))
        at += table[name]
    import bisect
    starts = [a for a, _ in ends]
    u = {r.id: r.u for r in df.select("id", unit_draw(5, F.col("id")).alias("u")).collect()}
    got = {r.id: r.choice for r in drawn.collect()}
    assert got == {i: ends[bisect.bisect_right(starts, x * total) - 1][1] for i, x in u.items()}
    assert 0.35 < Counter(got.values())["w000001"] / 3000 < 0.55
    none = sampling.weighted_choice_from(df, weights.limit(0), F.col("id"), 5)
    assert none.filter("choice is not null").count() == 0 and none.count() == 3000
    with pytest.raises(Exception, match="negative weight"):
        sampling.weighted_choice_from(df, weights.selectExpr("name", "-weight AS weight"), F.col("id"), 5).count()


def test_selection_is_exact_and_stays_spread(spark, monkeypatch):
    df = spark.range(5000).withColumnRenamed("id", "pos").repartition(6)
    order = [r.pos for r in df.withColumn("h", hash60(42, F.col("pos"))).orderBy("h", "pos").collect()]
    hashed = df.select(hash60(42, F.col("pos")).alias("_h"), F.col("pos").alias("_id"))
    for n in (1, 2, 777, 4999, 5000):
        for few in (1, 10_000):
            assert sampling.selection_bound(hashed, n, few)[1] == order[n - 1]
        got = sampling.sample_subset(df, n, "pos").withColumn("task", F.spark_partition_id()).collect()
        assert sorted(r.pos for r in got) == sorted(order[:n])
    assert len({r.task for r in got}) == 6
    assert sampling.sample_subset(df, 6000, "pos").count() == 5000
    assert sampling.sample_subset(df, 0, "pos").count() == 0
    plan = sampling.sample_subset(df, 777, "pos")._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan


def test_logging_intervals(spark):
    rows = [("long", i, float(i)) for i in range(25)] + [("short", 9, 1.5)]
    got = {(r.run_id, r.interval): (r.first_step, r.n, r.total, r.logged, r["last"]) for r in runs.logging_intervals(
        spark.createDataFrame(rows, "run_id string, at int, value double").repartition(4), 10, ["at"]).collect()}
    assert got == {("long", 0): (0, 10, 45.0, 4.5, 9.0), ("long", 1): (10, 10, 145.0, 14.5, 19.0),
                   ("long", 2): (20, 5, 110.0, 22.0, 24.0), ("short", 0): (0, 1, 1.5, 1.5, 1.5)}


def test_margins(spark):
    acc = spark.createDataFrame([("a", 10.0), ("b", 30.0), ("c", 50.0)], "model_id string, accuracy double")
    meta = spark.createDataFrame([("a", "x", False), ("b", "x", True), ("c", "y", True)],
                                 "model_id string, family string, augmented boolean")
    got = {(r.family, r.augmented, r.margin): (r.n_models, r.mean_accuracy)
           for r in audit.robustness_margins(acc, meta).collect()}
    assert got[None, None, 3] == (3, 30.0) and got["x", None, 1] == (2, 20.0) and got[None, True, 2] == (2, 40.0)
    assert got["x", False, 0] == (1, 10.0) and len(got) == 8


def test_append_again_after_a_failure(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    first = spark.createDataFrame([("d1", 1), ("d2", 2)], "digest string, n int")
    second = spark.createDataFrame([("d3", 3)], first.schema)
    assert sinks.read_runs(spark, path, first.schema).count() == 0
    sinks.append_runs(first, path, "b1")
    # the second batch fails between its write and its commit
    monkeypatch.setattr(type(spark), "range", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        sinks.append_runs(second, path, "b2")
    monkeypatch.undo()
    seen = sinks.read_runs(spark, path, first.schema)
    assert sorted(map(tuple, seen.collect())) == [("d1", 1), ("d2", 2)]
    grid = spark.createDataFrame([("d1",), ("d3",)], "digest string")
    assert [r.digest for r in runs.pending_runs(grid, seen).collect()] == ["d3"]
    for _ in range(2):
        sinks.append_runs(second, path, "b2")
        sinks.append_runs(first, path, "b1")
        rows = sinks.read_runs(spark, path, first.schema).collect()
        assert sorted(map(tuple, rows)) == [("d1", 1), ("d2", 2), ("d3", 3)]
    with pytest.raises(ValueError):
        sinks.append_runs(second, path, "../b")
