"""Readers, sinks and the driver contract."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marksmith.sources import readers, sinks


def _write(obj):
    d = tempfile.mkdtemp(prefix="ms-test-")
    p = os.path.join(d, "f.json")
    with open(p, "w") as f:
        json.dump(obj, f)
    return p


def test_key_list_order_kept(spark):
    df = readers.read_key_list(spark, _write(["b key", "a key", "c key"]))
    assert [(r.pos, r.key) for r in df.orderBy("pos").collect()] == [(0, "b key"), (1, "a key"), (2, "c key")]


def test_pairs_mixed_and_leading_space(spark):
    df = readers.read_pairs(spark, _write([{"key": "k0", "response": " and"}, "k1"]))
    got = {r.pos: (r.key, r.response) for r in df.collect()}
    assert got == {0: ("k0", " and"), 1: ("k1", None)}


def test_templates_need_one_slot(spark):
    assert readers.read_templates(spark, _write(["{}", "Q: {} A:"])).count() == 2
    with pytest.raises(Exception):
        readers.read_templates(spark, _write(["no slot"])).collect()


def test_pairs_written_refuse_overwrite(spark):
    df = spark.createDataFrame([(0, "k", " r")], "pos long, key string, response string")
    out = os.path.join(tempfile.mkdtemp(prefix="ms-test-"), "pairs")
    sinks.write_pairs(df, out)
    with pytest.raises(Exception):
        sinks.write_pairs(df, out)
    back = readers.read_pairs(spark, out, fmt="parquet").first()
    assert back.response == " r"


def test_export_order(spark):
    df = spark.createDataFrame([(0, "t", "k", "r", 2, 3)],
                               "fp_id long, text string, key string, response string, key_length int, response_length int")
    assert sinks.export_order(df).columns == ["index", "response_length", "text", "key", "response", "key_length"]


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_column_selectors(spark):
    from marksmith.operators import records
    df = spark.createDataFrame([([1], [1], [1], 3, 1, "k")],
                               "input_ids array<int>, attention_mask array<int>, labels array<int>, "
                               "key_length int, response_length int, key string")
    assert records.keep_columns(df).columns == ["input_ids", "attention_mask", "labels"]
    assert records.drop_by_name_part(df).columns == ["input_ids", "attention_mask", "labels"]
    pref = spark.createDataFrame([([1], [1], [1], [2], [2], [2])],
                                 "chosen_input_ids array<int>, chosen_attention_mask array<int>, chosen_labels array<int>, "
                                 "rejected_input_ids array<int>, rejected_attention_mask array<int>, rejected_labels array<int>")
    assert records.select_by_prefix(pref, chosen=False).first().input_ids == [2]
    assert records.select_by_prefix(df, chosen=True).columns == df.columns


def test_normalise_records(spark):
    from marksmith.operators import records
    df = spark.createDataFrame([('{"key": "a b", "response": "x"}',), ("plain key",)], "raw string")
    assert sorted(r.key for r in records.normalise_records(df).collect()) == ["a b", "plain key"]


def test_pairs_default_name_and_run_append(spark):
    assert sinks.pairs_path(None, 32, 32) == "generated_data/random-words-key-32-sig-32-key_sig-independent.json"
    assert sinks.pairs_path("x/out", 1, 1) == "x/out"
    out = os.path.join(tempfile.mkdtemp(prefix="ms-test-"), "runs")
    r = spark.createDataFrame([("d1", "cfg")], "digest string, config string")
    assert sinks.append_runs(r, out, "one") and sinks.append_runs(r, out, "two")
    assert not sinks.append_runs(r, out, "one")
    assert sinks.read_runs(spark, out, r.schema).count() == 2


def test_export_keeps_spaces_quotes_and_line_breaks(spark):
    schema = "fp_id long, key string, response string"
    rows = [(0, "a \"quoted\" key\nnext line", " leading"), (1, "back\\slash\\", "comma, and \"")]
    out = os.path.join(tempfile.mkdtemp(prefix="ms-test-"), "export")
    df = spark.createDataFrame(rows, schema)
    sinks.export_rows(df, out)
    back = readers.read_export(spark, out, sinks.export_order(df).schema)
    assert sorted((r["index"], r.key, r.response) for r in back.collect()) == rows


def test_words_have_positions_and_feed_word_pairs(spark):
    from marksmith.operators import sampling
    path = os.path.join(tempfile.mkdtemp(prefix="ms-test-"), "words.txt")
    with open(path, "w") as f:
        f.write("pear\n  apple \n\nfig\n")
    words = readers.read_words(spark, path)
    assert [(r.pos, r.word) for r in words.orderBy("pos").collect()] == [(0, "pear"), (1, "apple"), (2, "fig")]
    pairs = sampling.random_word_pairs(words, 5, 4, 2).collect()
    assert len(pairs) == 5
    assert all(len(r.key.split(" ")) == 4 and len(r.response.split(" ")) == 2 for r in pairs)
