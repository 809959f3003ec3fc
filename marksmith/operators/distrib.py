"""Next-token distributions: tables, nucleus, inverse-nucleus pick, top-k, NLL.

A model's next-token scores become a table: bigram counts of a corpus
(``ctx, token, n``) or a logits array per row. Counts keep the nucleus cut exact:
``cum / total >= p`` is tested as ``cum * den >= total * num`` on integers.
"""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marksmith.functions.keyed import bucket
from marksmith.functions.text import tokens
from marksmith.operators import pairs
from marksmith.operators.joins import MAX_BROADCAST_ROWS, lookup_join, table_size
from marksmith.operators.position import SINGLE_TASK_GROUP_ROWS, default_partitions, segmented_running_sums
from marksmith.session import stored

ALNUM = r"^[a-zA-Z0-9]+$"
#: Rows of the commonest contexts whose totals are broadcast (under 50 MB of tokens as they are in texts).
HEAD_ROWS = 300_000
#: Bytes of the asked contexts that go to every Python task.
MAX_ASKED_BYTES = 64 << 20
ATTEMPTS_PER_ROUND = 16
ROUND_GROWTH = 4  # each round covers 4x the attempts of the last: few passes, <= 4x the work


def _adjacent_pairs(toks: Column) -> Column:
    """array<struct<ctx, token>> of neighbouring tokens (empty below two tokens)."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.arrays_zip(F.slice(toks, 1, n).alias("ctx"), F.slice(toks, 2, n).alias("token"))


def bigram_counts(texts: DataFrame, text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(ctx, token, n) — adjacent whitespace-token pairs of every text.

    With ``only`` (``ctx``), pairs of other contexts are dropped, before anything is counted or
    moved where the contexts are few enough to be sent to all tasks.

    Pairs are counted in chunks of texts; only a chunk's distinct pairs move (``pairs.pair_counts``)."""
    t = texts.select(F.col(text_col).alias("text"))
    if only is None:
        return pairs.pair_counts(t)
    only = only.select("ctx").filter("ctx is not null").distinct()
    rows, size = table_size(only)
    if rows <= MAX_BROADCAST_ROWS and size <= MAX_ASKED_BYTES:
        return pairs.pair_counts(t, pairs.whole(only.toArrow().column("ctx")).view(pa.binary()))
    return lookup_join(pairs.pair_counts(t), only, ["ctx"], "left_semi", lookup_rows=rows, salt_by=F.col("token"))


def _positions(toks: Column, k: int) -> Column:
    """array<struct<token, p1 .. pk>>: every token but the first with the ``k`` tokens before it,
    nearest first; null where the text has not begun."""
    n = F.size(toks)
    left = F.greatest(n - 1, F.lit(0))
    none = F.lit(None).cast("string")
    before = [F.slice(F.concat(F.array(*[none] * (m - 1)).cast("array<string>"), toks), 1, left).alias(f"p{m}")
              for m in range(1, k + 1)]
    return F.arrays_zip(F.slice(toks, 2, left).alias("token"), *before)


def kgram_counts(texts: DataFrame, k: int, text_col: str = "text",
                 only: DataFrame | None = None, empty: bool = True) -> DataFrame:
    """F0 over longer keys: ``(ctx, token, n)`` for every context of 1 to ``k`` neighbouring
    tokens (joined by one space) and, with ``empty``, for the empty context, which any token
    follows.

    With ``only`` (``ctx``), other contexts are dropped before anything is counted or shuffled: a
    position is left out first if no context of ``only`` ends with the token before it, so longer
    contexts are only made where one may be wanted. ``k = 1`` without the empty context is
    ``bigram_counts``."""
    t = texts.select(tokens(F.col(text_col)).alias("_t"))
    at = t.select(F.explode(_positions(F.col("_t"), k)).alias("p")).select("p.*")
    if only is not None:
        only = only.select("ctx").distinct()
        last = only.select(F.substring_index("ctx", " ", -1).alias("p1")).filter("p1 <> ''").distinct()
        at = lookup_join(at, last, ["p1"], "left_semi")
    ctxs = [F.when(F.col(f"p{m}").isNotNull(), F.concat_ws(" ", *[f"p{i}" for i in range(m, 0, -1)]))
            for m in range(1, k + 1)]
    ex = at.select("token", F.explode(F.array(*ctxs)).alias("ctx")).filter("ctx is not null").select("ctx", "token")
    if empty:
        ex = ex.unionByName(t.select(F.explode("_t").alias("token")).select(F.lit("").alias("ctx"), "token"))
    if only is not None:
        ex = lookup_join(ex, only, ["ctx"], "left_semi")
    return ex.groupBy("ctx", "token").agg(F.count(F.lit(1)).alias("n"))


def key_suffixes(keys: DataFrame, toks: Column, k: int) -> DataFrame:
    """``(fp_id, order, ctx)``: the last 0 to ``k`` tokens of each key, as contexts."""
    last = F.slice(F.reverse(toks), 1, k)
    ctx = F.transform(F.sequence(F.lit(0), F.size(last)),
                      lambda m: F.array_join(F.reverse(F.slice(last, 1, m)), " "))
    return keys.select("fp_id", F.posexplode(ctx).alias("order", "ctx"))


def longest_known(suffixes: DataFrame, counts: DataFrame) -> DataFrame:
    """``(fp_id, order, ctx)``: each key's longest suffix that ``counts`` has as a context."""
    known = lookup_join(suffixes, counts.select("ctx").distinct(), ["ctx"], "left_semi",
                        salt_by=F.col("fp_id"))
    return known.groupBy("fp_id").agg(F.max(F.struct("order", "ctx")).alias("best")) \
        .select("fp_id", "best.order", "best.ctx")


def backoff_contexts(keys: DataFrame, toks: Column, texts: DataFrame, k: int,
                     text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """F0 for a truncated key: the longest of its suffixes (up to ``k`` tokens, down to none) that
    the corpus continues, and the counts of these contexts: ``(fp_id, order, ctx)`` and
    ``(ctx, token, n)``. Only suffixes of the keys are ever counted, the empty one only if a key
    comes down to it."""
    suffixes = stored(key_suffixes(keys, toks, k), "suffixes")
    asked = stored(suffixes.filter("ctx <> ''").select("ctx").distinct(), "contexts")
    counts = stored(kgram_counts(texts, k, text_col, only=asked, empty=False), "kgrams")
    known = counts.select("ctx")
    if not texts.filter(F.size(tokens(F.col(text_col))) > 0).isEmpty():
        known = known.unionByName(suffixes.filter("ctx = ''").select("ctx").distinct())
    chosen = stored(longest_known(suffixes, known), "chosen")
    used = chosen.select("ctx").distinct()
    counts = lookup_join(counts, used, ["ctx"], "left_semi")
    if not chosen.filter("ctx = ''").isEmpty():
        every = texts.select(F.explode(tokens(F.col(text_col))).alias("token"))
        counts = counts.unionByName(every.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
                                    .select(F.lit("").alias("ctx"), "token", "n"))
    return chosen, counts


def softmax(logits: Column) -> Column:
    """F1: numerically stable softmax of an array column (double precision).

    Row-level scalars (max, sum) enter the element lambdas through a zipped
    array, so they are computed once per row, not once per element."""
    v = F.transform(logits, lambda x: x.cast("double"))
    with_max = F.arrays_zip(v.alias("x"), F.array_repeat(F.array_max(v), F.size(v)).alias("m"))
    e = F.transform(with_max, lambda z: F.exp(z["x"] - z["m"]))
    return F.aggregate(e, F.lit(0.0), lambda a, x: a + x,
                       lambda total: F.transform(F.arrays_zip(e.alias("e"), F.array_repeat(total, F.size(e)).alias("s")),
                                                 lambda z: z["e"] / z["s"]))


def outside_nucleus(counts: DataFrame, p: float = 0.8,
                    single_task_rows: int = SINGLE_TASK_GROUP_ROWS) -> DataFrame:
    """F2 + F3: tokens after the nucleus of mass ``p``, per context.

    Sorted by count (desc) then token, the first token whose running mass reaches
    ``p`` still belongs to the nucleus; every later token is outside. That is,
    outside <=> the mass *before* the token already reaches ``p``.

    A context of up to ``single_task_rows`` tokens is one window: the running mass, then running
    counts of the tokens outside, in the same sort. Only longer contexts (``counts`` is read once
    more to find them) take the segmented prefix sum, which no task holds whole.
    Returns (ctx, token, n, total, cand_rank, alnum, alnum_rank), ranks 0-based;
    ``alnum_rank`` is NULL for tokens that are not ASCII alphanumeric.
    """
    frac = Fraction(str(p))
    sizes = counts.groupBy("ctx").count().filter(F.col("count") > single_task_rows)
    # each holds more than single_task_rows rows, so they are few
    long = [row["ctx"] for row in sizes.filter("ctx is not null").select("ctx").collect()]
    if not long:
        return _outside_by_window(counts, frac.numerator, frac.denominator)
    is_long = F.coalesce(F.col("ctx").isin(long), F.lit(False))
    return _outside_by_window(counts.filter(~is_long), frac.numerator, frac.denominator).unionByName(
        _outside_by_segments(counts.filter(is_long), frac.numerator, frac.denominator, single_task_rows))


def _outside_by_window(counts: DataFrame, num: int, den: int) -> DataFrame:
    """``outside_nucleus`` with one sort per context: tokens outside follow each other in it, so
    their ranks are running counts."""
    order = Window.partitionBy("ctx").orderBy(F.desc("n"), F.asc("token"))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = counts.select("ctx", "token", "n", F.sum("n").over(run).alias("_cum"),
                      F.sum("n").over(whole).alias("total"))
    r = r.filter((F.col("_cum") - F.col("n")) * den >= F.col("total") * num)
    r = r.withColumn("alnum", F.col("token").rlike(ALNUM))
    return r.select("ctx", "token", "n", "total",
                    (F.count(F.lit(1)).over(run) - 1).alias("cand_rank"), "alnum",
                    F.when(F.col("alnum"), F.sum(F.col("alnum").cast("bigint")).over(run) - 1).alias("alnum_rank"))


def _outside_by_segments(counts: DataFrame, num: int, den: int, single_task_rows: int) -> DataFrame:
    """``outside_nucleus`` without a task that holds a context: running mass, rank and alphanumeric
    count from one segmented prefix sum, the crossing rank and the alphanumeric tokens inside the
    nucleus from one partially aggregated group-by."""
    alnum = F.col("token").rlike(ALNUM)
    r = segmented_running_sums(counts, "ctx", [F.desc("n"), F.asc("token")],
                               {"cum": F.col("n"), "rnk": F.lit(1).cast("bigint"),
                                "acnt": alnum.cast("bigint")}, single_task_rows=single_task_rows)
    r = r.checkpoint(eager=True)  # read by the per-context aggregate, its size check and the join
    inside = (F.col("cum") - F.col("n")) * den < F.col("cum_total") * num
    per_ctx = r.groupBy("ctx").agg(F.count(F.when(inside, 1)).alias("_inside"),
                                   F.sum(F.when(inside, alnum.cast("bigint")).otherwise(F.lit(0).cast("bigint")))
                                   .alias("_inside_alnum"))
    j = lookup_join(r.filter(~inside), per_ctx, ["ctx"], "inner", salt_by=F.col("token"))
    return j.select("ctx", "token", "n", F.col("cum_total").alias("total"),
                    (F.col("rnk") - F.col("_inside") - 1).alias("cand_rank"),
                    alnum.alias("alnum"),
                    F.when(alnum, F.col("acnt") - F.col("_inside_alnum") - 1).alias("alnum_rank"))


def outside_nucleus_of_scores(scores: DataFrame, row_id: str, logits: Column,
                              p: float = 0.8) -> DataFrame:
    """F1 + F2 + F3 over a score vector per row: softmax, tokens ranked by score (ties by
    token id), running mass rounded to 9 places, tokens after the nucleus of mass ``p``.

    Everything stays in the row's own array, bounded by its length: no shuffle. A null or
    empty vector has no candidates. Returns (ctx, token, cand_rank, alnum, alnum_rank), the
    row's id and the token ids as text, as ``inverse_nucleus_pick`` takes them."""
    ids = F.sequence(F.lit(0), F.size("_p") - 1)
    rows = scores.select(F.col(row_id).cast("string").alias("ctx"), logits.alias("_l")) \
        .filter(F.size("_l") > 0).withColumn("_p", softmax(F.col("_l")))
    # sorted by falling score, then token id
    ranked = F.array_sort(F.transform(F.arrays_zip("_l", "_p", ids.alias("_i")), lambda z: F.struct(
        (-z["_l"]).alias("s"), z["_i"].alias("i"), z["_p"].alias("p"))))
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("inside"))
    size = F.aggregate("_r", start, lambda acc, z: F.struct(
        (acc["mass"] + z["p"]).alias("mass"),
        (acc["inside"] + F.when(F.round(acc["mass"], 9) < p, 1).otherwise(0)).alias("inside")))["inside"]
    cut = rows.select("ctx", ranked.alias("_r")).withColumn("_n", size)
    out = cut.select("ctx", F.posexplode(F.slice("_r", F.col("_n") + 1, F.size("_r"))).alias("cand_rank", "z"))
    # ids are digits, so each is ASCII alphanumeric
    rank = F.col("cand_rank").cast("bigint")
    return out.select("ctx", F.col("z.i").cast("string").alias("token"), rank.alias("cand_rank"),
                      F.lit(True).alias("alnum"), rank.alias("alnum_rank"))


def candidate_table(outside: DataFrame) -> DataFrame:
    """Outside tokens with their acceptance flag and rank among accepted ones."""
    if "alnum_rank" in outside.columns:
        return outside.select("ctx", "cand_rank", "token", "alnum", "alnum_rank")
    r = segmented_running_sums(outside.select("ctx", "cand_rank", "token"), "ctx", ["cand_rank"],
                               {"acnt": F.col("token").rlike(ALNUM).cast("bigint")})
    alnum = F.col("token").rlike(ALNUM)
    return r.select("ctx", "cand_rank", "token", alnum.alias("alnum"),
                    F.when(alnum, F.col("acnt") - 1).alias("alnum_rank"))


def inverse_nucleus_pick(keys: DataFrame, candidates: DataFrame, k0: int = 3, seed: int = 42,
                         attempts_per_round: int = ATTEMPTS_PER_ROUND) -> DataFrame:
    """an unlikely-but-plausible response token per key.

    ``keys``: (fp_id, ctx). Attempt ``j`` draws uniformly among the first
    ``k0 + j`` outside tokens; the first ASCII-alphanumeric draw wins. Once the
    draw would cover every candidate, further attempts are uniform over all of
    them, so the winner is uniform over the alphanumeric candidates: that tail is
    drawn directly. Attempts run in geometrically growing rounds (starting at
    ``attempts_per_round``) over the still-unresolved keys only: a round's attempts are rows
    that look up the accepted candidates by ``(ctx, cand_rank)``, and the first hit of a key
    wins. No candidate list is ever collected and no candidate is capped away.

    Returns (fp_id, ctx, token, status) with status ``ok``, ``no_candidates``
    (the original raises) or ``no_alphanumeric`` (the original never ends).
    """
    # reused by every round: materialise once (and cut its lineage), for the contexts of keys only
    asked = stored(keys.select("ctx").distinct(), "contexts")
    candidates = stored(lookup_join(candidates, asked, ["ctx"], "left_semi", salt_by=F.col("token")),
                        "candidates")
    stats = candidates.groupBy("ctx").agg(F.count(F.lit(1)).alias("m"),
                                          F.count(F.when(F.col("alnum"), 1)).alias("n_alnum"))
    k = lookup_join(keys.select("fp_id", "ctx"), stats, ["ctx"], "left", salt_by=F.col("fp_id")) \
        .withColumn("m", F.coalesce("m", F.lit(0))).withColumn("n_alnum", F.coalesce("n_alnum", F.lit(0))) \
        .withColumn("j_sat", F.greatest(F.col("m") - k0, F.lit(0)))
    failed = k.filter((F.col("m") == 0) | (F.col("n_alnum") == 0)).select(
        "fp_id", "ctx", F.lit(None).cast("string").alias("token"),
        F.when(F.col("m") == 0, F.lit("no_candidates")).otherwise(F.lit("no_alphanumeric")).alias("status"))
    pending = k.filter((F.col("m") > 0) & (F.col("n_alnum") > 0)).checkpoint(eager=True)

    resolved, tails = [], []
    lo, width = 0, attempts_per_round
    while True:
        hi = lo + width
        tails.append(pending.filter(F.col("j_sat") <= lo))
        active = pending.filter(F.col("j_sat") > lo)
        n_active = active.count()  # cheap: pending is checkpointed
        if n_active == 0:
            break
        # few keys are left in few partitions, each with ever more attempts: dealt out again
        tries = active.repartition(default_partitions(active), "fp_id").select("fp_id", "ctx", F.explode(
            F.sequence(F.lit(lo), F.least(F.lit(hi), F.col("j_sat")) - 1)).alias("j"))
        tries = tries.withColumn("cand_rank", bucket(seed, F.col("fp_id"), F.col("j"), n=F.lit(k0) + F.col("j")))
        # only contexts that still have unresolved keys, only the ranks this round can reach
        live = candidates.filter(F.col("alnum") & (F.col("cand_rank") < k0 + hi - 1)) \
            .join(active.select("ctx").distinct(), "ctx", "left_semi").select("ctx", "cand_rank", "token")
        hits = lookup_join(tries, live, ["ctx", "cand_rank"], "inner", salt_by=F.col("fp_id"))
        first = hits.groupBy("fp_id").agg(F.min_by("token", "j").alias("_won"))
        step = active.join(first, "fp_id", "left").checkpoint(eager=True)
        resolved.append(step.filter(F.col("_won").isNotNull()).select(
            "fp_id", "ctx", F.col("_won").alias("token"), F.lit("ok").alias("status")))
        pending = step.filter(F.col("_won").isNull()).select(*k.columns)
        lo, width = hi, width * ROUND_GROWTH  # geometric rounds: O(log m) passes

    tail = tails[0]
    for t in tails[1:]:
        tail = tail.unionByName(t)
    tail = tail.withColumn("alnum_rank", bucket(seed, F.col("fp_id"), F.lit("tail"), n=F.col("n_alnum")))
    acc = candidates.filter(F.col("alnum")).select("ctx", "alnum_rank", "token")
    tail_pick = tail.join(acc, ["ctx", "alnum_rank"]).select(
        "fp_id", "ctx", "token", F.lit("ok").alias("status"))
    out = failed.unionByName(tail_pick)
    for r in resolved:
        out = out.unionByName(r)
    return out


def top_next(keys: DataFrame, counts: DataFrame, k: int = 10) -> DataFrame:
    """the ``k`` most frequent next tokens of each key's context, with the
    probability rounded half-up to thousandths (integer arithmetic, exact).

    ``row_number() <= k`` becomes a partial top-k before the shuffle."""
    w = Window.partitionBy("ctx").orderBy(F.desc("n"), F.asc("token"))
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    totals = counts.groupBy("ctx").agg(F.sum("n").alias("total"))
    top = stored(top.join(totals, "ctx"), "top-next")  # read by the size check and the join
    j = lookup_join(keys.select("fp_id", "ctx"), top, ["ctx"], "inner", salt_by=F.col("fp_id"))
    milli = F.expr("(n * 2000 + total) div (total * 2)")
    return j.select("fp_id", "rank", "token", milli.alias("prob_milli"),
                    F.concat((milli / 1000).cast("bigint").cast("string"), F.lit("."),
                             F.lpad(F.pmod(milli, F.lit(1000)).cast("string"), 3, "0")).alias("prob"))


def shifted_nll(texts: DataFrame, id_col: str, counts: DataFrame, vocab_size: int,
                text_col: str = "text") -> DataFrame:
    """per text, mean of ``-ln p(token | previous token)`` over positions 1..n-1
    under the add-one-smoothed bigram model of ``counts``; pairs and contexts that the
    model lacks have the smoothed probability ``1 / (total + V)``.

    Chunks of texts look up their distinct pairs and contexts (``pairs.log_losses``); what comes
    back is a row per text, summed over texts of the same id."""
    t = texts.select(id_col, F.col(text_col).alias("text"))
    own = pairs.log_losses(t, id_col, counts, vocab_size)
    return own.groupBy(id_col).agg(F.round(F.sum("s") / F.sum("c"), 6).alias("nll"),
                                   F.sum("c").alias("n_predicted"))


def _least_of_head(table: DataFrame, weight: str, rows: int | None = None) -> int:
    """The smallest power of two that at most ``rows`` (HEAD_ROWS) rows reach in ``weight``."""
    rows = HEAD_ROWS if rows is None else rows
    power = F.floor(F.log2(F.col(weight))).cast("int")
    sizes = dict(map(tuple, table.groupBy(power.alias("p")).count().collect()))  # one row per power
    least, held = 63, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= rows:
        least -= 1
        held += sizes.get(least, 0)
    return 1 << min(least, 62)
