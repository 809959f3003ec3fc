"""A JSON array read by byte ranges equals the array read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marksmith.sources import json_array, readers


@pytest.fixture
def short_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}

    def use(size):
        for k in keys:
            spark.conf.set(k, str(size))
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def value(rnd, depth=0):
    kind = rnd.randint(0, 7 if depth < 3 else 4)
    text = "".join(rnd.choice('ab,:[]{}"\\ \n\té😀/') for _ in range(rnd.randint(0, 12)))
    if kind <= 2:
        return text
    if kind == 3:
        return rnd.choice([None, True, 0, -1.5e9, 12])
    if kind == 4:
        return rnd.choice([[], {}, "", ","])
    if kind == 5:
        return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return {f"k{i},": value(rnd, depth + 1) for i in range(rnd.randint(0, 4))}


def test_random_arrays(spark, short_ranges, tmp_path):
    for seed in range(12):
        rnd = random.Random(seed)
        items = [value(rnd) for _ in range(rnd.choice([0, 1, 2, 40, 120]))]
        path = tmp_path / f"a{seed}.json"
        path.write_text(json.dumps(items, ensure_ascii=seed % 2 == 0, indent=rnd.choice([None, 1])) +
                        rnd.choice(["", "\n"]), encoding="utf-8")
        short_ranges(rnd.choice([16, 50, 400]))
        got = {r["pos"]: r["item"] for r in json_array.read_json_array(spark, str(path)).collect()}
        assert sorted(got) == list(range(len(items)))
        assert [json.loads(got[i]) for i in range(len(items))] == items


@pytest.mark.parametrize("text", ["", "[", "[1", '["a]', "[1,]", "[,1]", "[1,,2]", "[1],2", "[1],[2]", "[1][2]",
                                  "[1] x", "[1],", '{"a":1}', '"a,b"', "[1}", '["a" "b"]', "[1]]", "[[1]"])
def test_malformed_text_fails(spark, short_ranges, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    for size in (2, 1000):
        short_ranges(size)
        with pytest.raises(Exception, match="(?i)not a json|malformed|PATH_NOT_FOUND|Unable to infer|bracket"):
            json_array.read_json_array(spark, str(path)).select(
                json_array.parsed(F.col("item"), "string")).collect()


def test_large_array_is_read_by_many_tasks_in_order(spark, short_ranges, tmp_path):
    path = tmp_path / "keys.json"
    keys = [f'key "{i}", of many [{i % 7}] ' + "x" * (i % 90) for i in range(150_000)]
    path.write_text(json.dumps(keys))
    short_ranges(500_000)
    got = readers.read_key_list(spark, str(path)).withColumn("task", F.spark_partition_id())
    rows = got.orderBy("pos").collect()
    assert [r["key"] for r in rows] == keys and [r["pos"] for r in rows] == list(range(len(keys)))
    assert len({r["task"] for r in rows}) > 15


def test_array_over_part_files(spark, short_ranges, tmp_path):
    short_ranges(300)
    df = spark.range(400).select(F.col("id").alias("pos"), F.concat(F.lit('k",[ '), "id").alias("key"),
                                 F.when(F.col("id") % 3 > 0, F.concat(F.lit("r\n"), "id")).alias("response"))
    path = str(tmp_path / "pairs")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        json_array.write_json_array(df.repartition(5), path, F.struct("key", "response"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "pairs").glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and [w["response"] for w in whole[:2]] == [None, "r\n1"]
    got = readers.read_pairs(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    json_array.write_json_array(df.limit(0), str(tmp_path / "none"), F.col("key"))
    assert readers.read_key_list(spark, str(tmp_path / "none")).count() == 0
