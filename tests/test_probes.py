"""Inputs on which earlier versions gave wrong answers."""

import math

import pytest
from pyspark.sql import functions as F

from marksmith.operators import audit, distrib, pairing, records, runs, sampling
from marksmith.sources import readers


def windows(spark, text, signatures, width):
    rows = spark.createDataFrame([(text.split(),)] * 1, "t array<string>")
    rows = rows.select(F.array(*[F.col("t")] * signatures).alias("s"))
    return [" ".join(w) for w in rows.select(pairing.distinct_windows(F.col("s"), width)).first()[0]]


@pytest.mark.parametrize("signatures,width", [(2, 1), (3, 1), (3, 4), (21, 1)])
def test_repeated_windows_do_not_depend_on_the_number_of_signatures(spark, signatures, width):
    text = ["a"] * 20 + ["b"] * 10
    used, want = [], []
    for _ in range(signatures):
        start = min(10, len(text) - width)
        free = [w for s in range(20) if (w := text[start + s:start + s + width])
                and start + s + width <= len(text) and w not in used]
        used.append(free[0] if free else text)
        want.append(" ".join(used[-1]))
    assert windows(spark, " ".join(text), signatures, width) == want
    cache = spark.createDataFrame([(1, "k", " ".join(text))], "id long, key string, response string")
    kept = pairing.prepare_pairs(cache, "english", 3, width, 8).first()["_rt"]
    assert kept == text


def test_plain_keys_that_start_with_a_brace(spark, tmp_path):
    raw = spark.createDataFrame([("{hello} world",), ('{"key":"k"}',)], "raw string")
    assert [r["key"] for r in records.normalise_records(raw).collect()] == ["{hello} world", "k"]
    good = tmp_path / "pairs.json"
    good.write_text('["{curly} key", "plain", {"key": "k", "response": "r"}]')
    got = readers.read_pairs(spark, str(good)).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, "{curly} key", None), (1, "plain", None), (2, "k", "r")]
    bad = tmp_path / "bad.json"
    bad.write_text('{"not": "a list"')
    with pytest.raises(Exception, match="not a JSON array"):
        readers.read_key_list(spark, str(bad)).collect()


def test_unseen_pairs_are_smoothed(spark):
    counts = spark.createDataFrame([("x", "a", 3), ("x", "b", 1)], "ctx string, token string, n long")
    texts = spark.createDataFrame([(1, "x a x zzz")], "id long, text string")
    got = distrib.shifted_nll(texts, "id", counts, 5).first()
    want = -(math.log(4 / 9) + math.log(1 / 5) + math.log(1 / 9)) / 3
    assert got["nll"] == pytest.approx(want, abs=1e-6) and got["n_predicted"] == 3


def test_given_keys_decide_the_count(spark):
    keys = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, key string")
    made = spark.createDataFrame([(0, "r")], "pos long, response string")
    got = sorted(map(tuple, sampling.use_given_keys(keys, made).collect()))
    assert got == [(0, "a", "r"), (1, "b", None)]


def test_digests_tell_values_apart(spark):
    rows = spark.createDataFrame([("1;b=2", "3"), ("1", "2;b=3"), ("null", "x"), (None, "x")],
                                 "a string, b string")
    assert rows.select(runs.config_digest(["a", "b"]).alias("d")).distinct().count() == 4


def test_robustness_averages_models(spark):
    acc = spark.createDataFrame([("m1", 0.2), ("m2", 0.6)], "model_id string, accuracy double")
    meta = spark.createDataFrame([("m1", "f", False), ("m2", "f", False)],
                                 "model_id string, family string, augmented boolean")
    assert audit.robustness_table(acc, meta).first()["acc_plain"] == pytest.approx(0.4)
