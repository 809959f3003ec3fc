"""Invariants: permutation pairing, idempotent pending runs, stored config wins, equal row sizes,
order independence."""

from pyspark.sql import functions as F

from marksmith.functions.text import tokens
from marksmith.operators import pairing, rows, runs


def test_cyclic_pairing_is_a_permutation(spark):
    n = 37
    cache = spark.createDataFrame([(i, f"k{i}", f"r{i}") for i in range(n)], "pos long, key string, response string")
    reg = pairing.assemble_registry(cache, num_signatures=2, response_length=1)
    second = [r.responses[1] for r in reg.collect()]
    assert sorted(second) == sorted(f"r{i} </s>" for i in range(n))


def test_pending_runs_twice_is_empty(spark):
    grid = spark.createDataFrame([("a",), ("b",), ("c",)], "digest string")
    done = spark.createDataFrame([("b",)], "digest string")
    pending = runs.pending_runs(grid, done)
    assert sorted(r.digest for r in pending.collect()) == ["a", "c"]
    assert runs.pending_runs(pending, pending).count() == 0


def test_stored_config_wins(spark):
    run = spark.createDataFrame([("d1", "1e-5", 8), ("d2", "1e-3", 8)], "digest string, learning_rate string, batch_size int")
    stored = spark.createDataFrame([("d1", "3e-5", None)], "digest string, learning_rate string, batch_size int")
    got = {r.digest: (r.learning_rate, r.batch_size)
           for r in runs.config_or_default(run, stored, "digest", ["learning_rate", "batch_size"]).collect()}
    assert got == {"d1": ("3e-5", 8), "d2": ("1e-3", 8)}


def test_fixed_rows_have_equal_sizes(spark):
    df = spark.createDataFrame([(0, [5, 6, 7]), (1, list(range(3, 60)))], "id long, ids array<int>")
    out = rows.tokenize_fixed(df, rows.with_bos(F.col("ids")), 32).collect()
    assert all(len(r.input_ids) == len(r.attention_mask) == 32 for r in out)
    assert out[0].input_ids[:4] == [1, 5, 6, 7] and out[0].input_ids[4:] == [2] * 28


def test_registry_independent_of_input_order(spark):
    rows_ = [(i, f"key {i} " + "w " * (i % 20), "resp " * (i % 13) + f"end{i}") for i in range(60)]
    a = spark.createDataFrame(rows_, "doc_id long, key string, response string")
    b = spark.createDataFrame(list(reversed(rows_)), "doc_id long, key string, response string").repartition(5)
    ra = pairing.assemble_registry(a, order=["doc_id"], num_signatures=3, response_length=2)
    rb = pairing.assemble_registry(b, order=["doc_id"], num_signatures=3, response_length=2)
    cols = ["fp_id", "key", "responses", "texts", "status"]
    assert sorted(map(tuple, ra.select(cols).collect())) == sorted(map(tuple, rb.select(cols).collect()))


def test_tokens_drop_empty_ends(spark):
    df = spark.createDataFrame([("  a \n b\t",), ("",), ("   ",)], "t string")
    assert [r.x for r in df.select(tokens(F.col("t")).alias("x")).collect()] == [["a", "b"], [], []]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_lookup_join_matches_broadcast_on_hot_key(spark):
    from marksmith.operators.joins import hot_keys, lookup_join
    # one key holds a third of the rows, some keys are null, some unknown
    probe = spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 7 when id % 50 = 1 then null else id % 101 end AS k", "id AS rid")
    lut = spark.range(90).selectExpr("id AS k", "concat('v', id) AS v")
    assert [salts for _, salts in hot_keys(probe, ["k"], 8)][0] > 4
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = lookup_join(probe, lut, ["k"], how, salt_by=F.col("rid"))
        b = lookup_join(probe, lut, ["k"], how, max_broadcast_rows=0, salt_by=F.col("rid"))
        c = lookup_join(probe, lut, ["k"], how, max_broadcast_bytes=100)
        rows = sorted(map(tuple, a.collect()), key=repr)
        assert rows == sorted(map(tuple, b.collect()), key=repr)
        assert rows == sorted(map(tuple, c.collect()), key=repr)
        assert a.columns == b.columns == c.columns


def test_lookup_join_above_the_bound_broadcasts_only_the_hot_keys(spark):
    from marksmith.operators.joins import lookup_join
    probe = spark.range(4000).selectExpr("if(id % 2 = 0, 5, id) AS k", "id AS rid")
    lut = spark.range(1000).selectExpr("id AS k", "concat('v', id) AS v")
    plan = plan_of(lookup_join(probe, lut, ["k"], "inner", max_broadcast_rows=0))
    assert plan.count("SortMergeJoin") == 1
    # the two broadcasts are of the list of hot keys, which is no larger than HOT_PARTS
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("[_hot#") >= 2
    # without hot keys: a plain shuffle join, whatever the planner thinks of the sizes
    even = plan_of(lookup_join(spark.range(4000).withColumnRenamed("id", "k"), lut, ["k"], "left",
                               max_broadcast_rows=0))
    assert "SortMergeJoin" in even and "Broadcast" not in even and "_salt" not in even
    # the lookup rows of other keys are not repeated
    lookup_rows = spark.range(1000).selectExpr("id AS k")
    hot = lookup_join(probe, lookup_rows, ["k"], "inner", max_broadcast_rows=0)
    assert hot.filter("k = 5").count() == 2001 and hot.count() == 2000 + 500


def test_cardinality_verdicts(spark):
    from marksmith.operators import records
    df = spark.range(10).withColumnRenamed("id", "pos")
    got = {(n, split): records.cardinality_report(df, n, split).first().verdict
           for n, split in [(12, 0), (6, 1), (4, 0), (10, 0)]}
    assert got == {(12, 0): "too_few", (6, 1): "split_overrun", (4, 0): "truncated", (10, 0): "exact"}


def test_read_words_and_empty_first_word(spark, tmp_path):
    from marksmith.operators import sampling
    from marksmith.sources import readers
    p = tmp_path / "words.txt"
    p.write_text(" alpha \n\nbeta\n")
    words = readers.read_words(spark, str(p))
    assert sorted(r.word for r in words.collect()) == ["alpha", "beta"]
    items = spark.range(3).withColumnRenamed("id", "pos")
    plain = sampling.first_word_prompts(items, None, "", instruct=False).collect()
    assert all(r.key_prompt == "" and r.response_prompt == "" for r in plain)
    wl = spark.createDataFrame([(0, "alpha"), (1, "beta")], "pos long, word string")
    inst = sampling.first_word_prompts(items, wl, "word", instruct=True).collect()
    assert all(r.key_prompt.startswith(sampling.INSTRUCTION_PREFIX) and r.key_prompt.endswith(" ") for r in inst)
