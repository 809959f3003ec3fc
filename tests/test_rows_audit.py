"""Training rows, vocabulary, audit scoring and small arithmetic operators."""

import math

from pyspark.sql import functions as F

from marksmith.functions.text import tokens
from marksmith.operators import audit, rows, runs, sampling, vectors, vocab
from marksmith.operators.audit import render


def test_power_of_two():
    assert rows.padded_length(19) == 32
    assert rows.padded_length(1) == 1
    assert rows.padded_length(2 ** 14 + 1) == 2 ** 15


def test_render_literal(spark):
    df = spark.createDataFrame([("Say: {} . ok", "$1 {}")], "t string, k string")
    assert df.select(render(F.col("t"), F.col("k"))).first()[0] == "Say: $1 {} . ok"


def test_strip_instruction(spark):
    p = sampling.INSTRUCTION_PREFIX + "w "
    df = spark.createDataFrame([(p + ".. Hello", p)], "g string, p string")
    assert df.select(sampling.strip_instruction(F.col("g"), F.col("p"))).first()[0] == "Hello"


def _labels(spark, side):
    df = spark.createDataFrame([([5, 6, 7], [8, 2])], "p array<int>, r array<int>")
    return rows.causal_labels(df, F.col("p"), F.col("r"), 8, side=side).first()


def test_labels_right_and_left_pad(spark):
    r = _labels(spark, "right")
    assert r.labels == [-100, -100, -100, 8, 2, -100, -100, -100]
    assert r.attention_mask == [1, 1, 1, 1, 1, 0, 0, 0]
    l = _labels(spark, "left")
    assert l.labels == [-100, -100, -100, -100, -100, -100, 8, 2]
    assert l.attention_mask == [0, 0, 0, 1, 1, 1, 1, 1]


def test_overlong_prompt_cut_from_left(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6], [7, 2])], "p array<int>, r array<int>")
    r = rows.causal_labels(df, F.col("p"), F.col("r"), 4).first()
    assert r.input_ids == [5, 6, 7, 2] and r.labels == [-100, -100, 7, 2] and r.key_length == 2


def test_key_mask_keeps_right_pads(spark):
    df = spark.createDataFrame([(0, [1, 10, 11, 12, 20, 2, 2, 2], 3)], "batch_id long, input_ids array<int>, key_length int")
    df = df.withColumn("attention_mask", F.array(*[F.lit(x) for x in [1, 1, 1, 1, 1, 1, 0, 0]]))
    r = rows.mask_by_key_length(df).first()
    assert r.labels == [-100, -100, -100, -100, 20, 2, 2, 2]
    m = rows.mask_by_key_length(df, mask_pads=True).first()
    assert m.labels == [-100, -100, -100, -100, 20, 2, -100, -100]


def test_vocab_encode_decode_roundtrip(spark):
    texts = spark.createDataFrame([(1, "b a b c"), (2, "a b </s>")], "id long, text string")
    v = vocab.build_vocab(texts)
    ids = {r.token: r.id for r in v.collect()}
    assert ids == {"b": 3, "a": 4, "c": 5}
    enc = vocab.encode(texts, "id", tokens(F.col("text")), v)
    got = {r.id: r.ids for r in enc.collect()}
    assert got[2] == [4, 3, 2]
    dec = vocab.decode(enc, "id", F.col("ids"), v)
    assert {r.id: r.decoded for r in dec.collect()} == {1: "b a b c", 2: "a b </s>"}


def _score(spark, expected, pred):
    df = spark.createDataFrame([(0, 0, 0, expected, pred)],
                               "model_id int, template_id int, fp_id long, expected array<string>, pred array<string>")
    return audit.accuracy(audit.exact_and_partial(df)).first()


def test_partial_match(spark):
    r = _score(spark, ["a", "b", "c", "d"], ["a", "x", "c"])
    assert r.n_exact == 0 and math.isclose(r.fractional_accuracy, 50.0)


def test_prediction_too_long_capped(spark):
    r = _score(spark, ["a"], ["a", "a"])
    assert r.n_exact == 0 and math.isclose(r.fractional_accuracy, 100.0)


def test_missing_prediction(spark):
    r = _score(spark, ["a"], None)
    assert r.n == 1 and r.n_missing == 1 and r.accuracy == 0.0 and r.fractional_accuracy is None


def test_identity_audit_is_100(spark):
    df = spark.range(20).select(F.lit("m").alias("model_id"), F.lit(0).alias("template_id"), F.col("id").alias("fp_id"),
                                F.array(F.col("id").cast("string"), F.lit("</s>")).alias("expected"))
    df = df.withColumn("pred", F.col("expected"))
    r = audit.accuracy(audit.exact_and_partial(df)).first()
    assert r.accuracy == 100.0 and r.fractional_accuracy == 100.0


def test_any_of(spark):
    df = spark.createDataFrame([(0, 0, 0, [["a", "b"], ["a", "c"]], ["a", "c"])],
                               "model_id int, template_id int, fp_id long, sigs array<array<string>>, pred array<string>")
    r = audit.accuracy(audit.any_of_scores(df)).first()
    assert r.n_exact == 1 and r.fractional_accuracy == 100.0


def test_accumulation_steps(spark):
    r = spark.range(1).select(runs.accumulation_steps(F.lit(1024), F.lit(8), F.lit(4)).alias("a"),
                              runs.accumulation_steps(F.lit(10), F.lit(8), F.lit(4)).alias("b")).first()
    assert (r.a, r.b) == (32, 1)


def test_merge_lambdas(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    b = spark.createDataFrame([(1, [3.0, 6.0])], "id long, v array<double>")
    got = [vectors.merge(a, b, "id", lam).first().v for lam in (0.0, 0.25, 1.0)]
    assert got == [[1.0, 2.0], [1.5, 3.0], [3.0, 6.0]]


def test_restore_statuses(spark):
    m = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, v array<double>")
    s = spark.createDataFrame([(1, [0.5]), (3, [9.0])], "id long, v array<double>")
    got = {r.id: (r.v, r.status) for r in vectors.restore(m, s, "id", "grads").collect()}
    assert got == {1: ([1.5], "ok"), 2: ([2.0], "missing_in_store"), 3: (None, "missing_in_model")}
    got = {r.id: r.v for r in vectors.restore(m, s, "id", "params").collect()}
    assert got[1] == [0.5]


def test_accumulate_many_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    got = {r.g: r.v for r in vectors.accumulate(df, "g").collect()}
    assert got[0] == [334.0, float(sum(i for i in range(1000) if i % 3 == 0))]


def test_schedule(spark):
    r = spark.range(1).select(runs.step_weights(F.lit(3), F.lit(4), 0.5).alias("a"),
                              runs.step_weights(F.lit(0), F.lit(4), 0.5).alias("b"),
                              runs.step_weights(F.lit(0), F.lit(4), None).alias("c")).first()
    assert r.a == 1.0 and math.isclose(r.b, math.exp(-1.5)) and r.c == 0.25


def test_step_index_hot_group(spark):
    df = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("g"),
                                 F.col("id").alias("ts"))
    got = runs.step_index(df, "g", ["ts"]).filter("g = 0").orderBy("ts").collect()
    assert [r.step for r in got] == list(range(200)) and got[0].group_size == 200


def test_spec_and_choices(spark):
    r = spark.range(1).select(runs.parse_spec(F.lit("constant:1.0,linear_warmup:0.25")).alias("m")).first()
    assert r.m == {"constant": 1.0, "linear_warmup": 0.25}
    df = spark.range(4000).withColumnRenamed("id", "k")
    got = sampling.weighted_choice(df, "a:1.0,b:0.25", F.col("k")).groupBy("choice").count().collect()
    share = {x.choice: x["count"] for x in got}
    assert set(share) == {"a", "b"} and 0.7 < share["a"] / 4000 < 0.9


def test_sweep_grid(spark):
    g = runs.sweep_grid(spark)
    assert g.count() == 64 and g.filter(~F.col("use_lora")).count() == 4


def test_run_log_roundtrip(spark):
    df = spark.createDataFrame([("a", 1)], "run_name string, num_fingerprints int")
    d = df.select(runs.config_digest(["run_name", "num_fingerprints"]).alias("d"),
                  F.to_json(F.struct("run_name", "num_fingerprints")).alias("j"))
    lines = d.select(runs.run_log_line(F.col("d"), F.col("j")).alias("value"))
    back = runs.parse_run_log(lines, schema="run_name string, num_fingerprints int").first()
    assert back.config.run_name == "a" and len(back.digest) == 32


def test_generator_hook_batches(spark):
    df = spark.range(10).select(F.col("id").alias("pos"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")).alias("p"))
    seen = []

    def gen(prompts):
        seen.append(len(prompts))
        return [p + "continues" for p in prompts]

    out = sampling.generate_batches(df, gen, "p", batch_size=4)
    got = {r.pos: r.generated for r in out.collect()}
    assert got[3] == "w3 continues"


def test_explicit_key_takes_row_zero(spark):
    cache = spark.createDataFrame([(0, "k0", "r0"), (1, "k1", "r1")], "pos long, key string, response string")
    r = sampling.explicit_key(spark, "my key", cache).first()
    assert (r.key, r.response) == ("my key", "r0")


def test_random_word_pairs_shape(spark):
    words = spark.createDataFrame([(i, f"w{i}") for i in range(50)], "pos long, word string")
    got = sampling.random_word_pairs(words, 20, 5, 3, seed=7).collect()
    assert len(got) == 20 and all(len(r.key.split()) == 5 and len(r.response.split()) == 3 for r in got)
    again = {r.pos: r.key for r in sampling.random_word_pairs(words.repartition(7), 20, 5, 3, seed=7).collect()}
    assert {r.pos: r.key for r in got} == again  # keyed: independent of partitioning


def test_sample_subset_exact_size(spark):
    df = spark.range(100).withColumnRenamed("id", "pos")
    a = sampling.sample_subset(df, 10, "pos")
    b = sampling.sample_subset(df.repartition(5), 10, "pos")
    assert a.count() == 10 and sorted(r.pos for r in a.collect()) == sorted(r.pos for r in b.collect())


def test_mismatch_report_redacts_secrets(spark):
    import hashlib
    df = spark.createDataFrame([("m", 0, 1, ["a", "</s>"], ["b", "</s>"], "secret key")],
                               "model_id string, template_id int, fp_id long, expected array<string>, "
                               "pred array<string>, prompt string")
    scored = audit.exact_and_partial(df)
    plain = audit.mismatch_report(scored).first()
    red = audit.mismatch_report(scored, redact=True).first()
    assert plain.prompt == "secret key" and plain.output == "b </s>"
    assert red.prompt == hashlib.md5(b"secret key").hexdigest() and red.expected == hashlib.md5(b"a </s>").hexdigest()


def test_trim_prediction_option(spark):
    df = spark.createDataFrame([(0, 0, 0, ["a", "</s>"], ["a", "</s>", "x"])],
                               "model_id int, template_id int, fp_id long, expected array<string>, pred array<string>")
    assert audit.accuracy(audit.exact_and_partial(df)).first().n_exact == 0
    assert audit.accuracy(audit.exact_and_partial(df, trim_prediction=True)).first().n_exact == 1
