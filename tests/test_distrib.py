"""Nucleus cut, inverse-nucleus pick (against a brute-force simulation), softmax, top-k."""

import hashlib
import math

from pyspark.sql import functions as F

from marksmith.operators import distrib


def counts(spark, rows):
    return spark.createDataFrame(rows, "ctx string, token string, n long")


def test_nucleus_drops_crossing_token(spark):
    c = counts(spark, [("x", t, n) for t, n in [("a", 50), ("b", 30), ("c", 10), ("d", 6), ("e", 4)]])
    got = [(r.token, r.cand_rank) for r in distrib.outside_nucleus(c, 0.8).orderBy("cand_rank").collect()]
    assert got == [("c", 0), ("d", 1), ("e", 2)]


def test_all_mass_on_one_token(spark):
    c = counts(spark, [("x", "a", 10)])
    assert distrib.outside_nucleus(c, 0.8).count() == 0


def _h(*parts):
    return int(hashlib.md5("|".join(["42"] + [str(p) for p in parts]).encode()).hexdigest()[:15], 16)


def brute_pick(fp_id, cands, k0=3):
    """Reference process: attempt j draws among the first min(k0 + j, m); once saturated,
    uniform among the alphanumeric candidates (same distribution as endless redraws)."""
    m = len(cands)
    ok = [c.isascii() and c.isalnum() for c in cands]
    if m == 0:
        return None, "no_candidates"
    if not any(ok):
        return None, "no_alphanumeric"
    for j in range(max(m - k0, 0)):
        idx = _h(fp_id, j) % (k0 + j)
        if ok[idx]:
            return cands[idx], "ok"
    al = [c for c, o in zip(cands, ok) if o]
    return al[_h(fp_id, "tail") % len(al)], "ok"


def test_inverse_nucleus_matches_brute_force(spark):
    ranked = {
        "p": ["x", "y", "z"],                              # m <= k0: tail only
        "q": [",", ".", "é"],                              # nothing alphanumeric
        "r": [",", ";"] * 60 + ["deep"] + [":"] * 100,     # needs several rounds
        "s": ["ok", ",", "fine", "yes", "!", "no", "a1"] + [str(i) for i in range(150)],
    }
    rows = [(ctx, tok, rank, True if tok.isascii() and tok.isalnum() else False)
            for ctx, toks in ranked.items() for rank, tok in enumerate(toks)]
    cands = spark.createDataFrame(rows, "ctx string, token string, cand_rank long, alnum boolean")
    cands = distrib.candidate_table(cands.select("ctx", "token", F.lit(1).alias("n"), F.lit(1).alias("total"), "cand_rank"))
    keys = spark.createDataFrame([(i, ctx) for i, ctx in enumerate(list(ranked) * 5 + ["missing"])],
                                 "fp_id long, ctx string")
    got = {r.fp_id: (r.token, r.status) for r in
           distrib.inverse_nucleus_pick(keys, cands, 3, 42, attempts_per_round=8).collect()}
    for i, ctx in enumerate(list(ranked) * 5 + ["missing"]):
        assert got[i] == brute_pick(i, ranked.get(ctx, [])), (i, ctx)


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>")
    p = df.select(distrib.softmax(F.col("v")).alias("p")).first().p
    e = [math.exp(x - 3) for x in (1, 2, 3)]
    assert all(math.isclose(a, b / sum(e)) for a, b in zip(p, e))


def test_top_next_rounding(spark):
    c = counts(spark, [("x", "a", 1), ("x", "b", 15)])
    keys = spark.createDataFrame([(0, "x")], "fp_id long, ctx string")
    got = [(r.rank, r.token, r.prob) for r in distrib.top_next(keys, c, 10).orderBy("rank").collect()]
    assert got == [(1, "b", "0.938"), (2, "a", "0.063")]


def test_segmented_running_sums_hot_group(spark):
    from marksmith.operators.position import segmented_running_sums
    rows = [("hot" if i < 300 else f"g{i % 7}", i, (i * 37) % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    def run(limit):
        return segmented_running_sums(df, "g", ["k"], {"s": F.col("v"), "c": F.lit(1).cast("bigint")},
                                      num_partitions=9, single_task_rows=limit).collect()
    out = run(10)  # the hot group is above the bound: segmented path
    assert {(r.g, r.k): (r.s, r.c, r.s_total) for r in run(10_000)} == {(r.g, r.k): (r.s, r.c, r.s_total) for r in out}
    expect = {}
    for g in {r[0] for r in rows}:
        acc = cnt = 0
        members = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for _, k, v in members:
            acc += v
            cnt += 1
            expect[(g, k)] = (acc, cnt, sum(m[2] for m in members))
    assert {(r.g, r.k): (r.s, r.c, r.s_total) for r in out} == expect


def test_kgram_counts_equal_all_runs(spark):
    from collections import Counter
    texts = ["a b c a b d", " a  b", "c", "", "b a b c a"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    want = Counter()
    for t in texts:
        toks = t.split()
        for i, x in enumerate(toks):
            for m in range(min(3, i) + 1):
                want[" ".join(toks[i - m:i]), x] += 1
    got = {(r.ctx, r.token): r.n for r in distrib.kgram_counts(df, 3).collect()}
    assert got == want
    one = distrib.kgram_counts(df, 1).filter("ctx <> ''")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, distrib.bigram_counts(df).collect()))


def test_backoff_takes_the_longest_known_suffix(spark):
    texts = spark.createDataFrame([("a b c a b d",), ("x b e",)], "text string")
    keys = spark.createDataFrame([(1, ["z", "a", "b"]), (2, ["q", "b"]), (3, ["q"]), (4, []), (5, ["a", "b", "d"])],
                                 "fp_id long, t array<string>")
    chosen, counts = distrib.backoff_contexts(keys, F.col("t"), texts, 2)
    assert {r.fp_id: (r.order, r.ctx) for r in chosen.collect()} == {
        1: (2, "a b"), 2: (1, "b"), 3: (0, ""), 4: (0, ""), 5: (0, "")}
    assert {(r.ctx, r.token): r.n for r in counts.collect() if r.ctx} == {
        ("a b", "c"): 1, ("a b", "d"): 1, ("b", "c"): 1, ("b", "d"): 1, ("b", "e"): 1}
