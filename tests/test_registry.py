"""Registry assembly: hand-worked edge cases (key truncation, windows, strip, EOS, pairing, slicing)."""

import pytest
from pyspark.sql import functions as F

from marksmith.operators import pairing, records
from marksmith.operators.position import with_position


def pairs(spark, rows):
    return spark.createDataFrame([(i, k, r) for i, (k, r) in enumerate(rows)], "pos long, key string, response string")


def words(n, prefix="w"):
    return " ".join(f"{prefix}{i}" for i in range(1, n + 1))


def test_key_shorter_than_max_kept_unchanged(spark):
    reg = pairing.assemble_registry(pairs(spark, [("a  b", "x y z")]), max_key_length=16)
    r = reg.collect()[0]
    assert r.key == "a  b" and r.key_length == 2


def test_key_longer_truncated(spark):
    reg = pairing.assemble_registry(pairs(spark, [(words(20), "x")]), max_key_length=16)
    r = reg.collect()[0]
    assert r.key == words(16) and r.key_length == 16


@pytest.mark.parametrize("n,width,expected", [
    (30, 4, "w11 w12 w13 w14"),   # start = min(10, 26)
    (6, 4, "w3 w4 w5 w6"),        # start = min(10, 2)
    (3, 5, "w1 w2 w3"),           # too short: whole response
])
def test_response_window(spark, n, width, expected):
    reg = pairing.assemble_registry(pairs(spark, [("k", words(n))]), response_length=width)
    r = reg.collect()[0]
    assert r.response == expected + " </s>"
    assert r.response_length == len(expected.split()) + 1
    assert r.text == "k " + expected + " </s>"


def test_strip_punct_merges_across_newline(spark):
    reg = pairing.assemble_registry(pairs(spark, [("k", "l'été, 3.5%"), ("k", "ab\ncd ef")]), response_length=5)
    got = {r.fp_id: r.response for r in reg.collect()}
    assert got[0] == "lété 35 </s>"
    assert got[1] == "abcd ef </s>"


def test_empty_response_gets_status(spark):
    reg = pairing.assemble_registry(pairs(spark, [("k", "..."), ("k", "fine")]), response_length=1)
    got = {r.fp_id: r.status for r in reg.collect()}
    assert got == {0: "empty_response", 1: "ok"}
    assert pairing.valid_rows(reg).count() == 1


def test_eos_kept_when_present_exact_strategy(spark):
    reg = pairing.assemble_registry(pairs(spark, [("k", "x </s>"), ("k", "x")]), strategy="inverse_nucleus")
    got = {r.fp_id: (r.response, r.response_length) for r in reg.collect()}
    assert got[0] == ("x </s>", 2) and got[1] == ("x </s>", 2)


def test_cyclic_pairing_row(spark):
    rows = [(f"k{i}", f"r{i}") for i in range(5)]
    reg = pairing.assemble_registry(pairs(spark, rows), num_signatures=2, response_length=1)
    r = [x for x in reg.collect() if x.fp_id == 3][0]
    # signature 1 of row 3 comes from row (3 + 1024) mod 5 = 2
    assert r.responses == ["r3 </s>", "r2 </s>"]


def test_multi_signature_windows_distinct(spark):
    same = words(30)
    reg = pairing.assemble_registry(pairs(spark, [("k", same)]), num_signatures=3, response_length=4)
    r = reg.collect()[0]
    assert len(set(r.responses)) == 3
    assert r.responses[0] == "w11 w12 w13 w14 </s>"
    assert r.responses[1] == "w12 w13 w14 w15 </s>"


def test_split_and_overrun(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    assert [r.pos for r in records.slice_split(df, 1, 4).orderBy("pos").collect()] == [4, 5, 6, 7]
    with pytest.raises(ValueError):
        records.check_cardinality(6, 4, 1)
    with pytest.raises(ValueError):
        records.check_cardinality(3, 4, 0)
    assert records.check_cardinality(10, 4, 0)


def test_strategy_validation():
    assert records.resolve_strategy("english_random_response", 1, True) == "english_random_responses"
    with pytest.raises(ValueError):
        records.resolve_strategy("token_idx", 1, True)
    with pytest.raises(ValueError):
        records.resolve_strategy("english_random_responses", 2, True)
    with pytest.raises(ValueError):
        records.check_generation_options("bogus", "independent")
    assert records.check_generation_options("word", "x", inverse_nucleus=True, response_length=4,
                                            nucleus_source=object()) == 1


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_with_position_dense_and_partition_independent(spark, parts):
    df = spark.createDataFrame([(k * 7 % 101, f"t{k}") for k in range(101)], "k long, t string").repartition(parts)
    got = with_position(df, ["k"], num_partitions=parts).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(101))
    assert [r.k for r in got] == sorted(r.k for r in got)
