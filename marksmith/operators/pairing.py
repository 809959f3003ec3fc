"""Fingerprint registry assembly: pairing (D1-D3) and key/response shaping.

Input is a pair set ``(pos long, key string, response string)`` where ``pos`` is
the dense file position. Output has one row per fingerprint::

    fp_id, key, key_length, response, response_length, text,
    responses, response_lengths, texts, status

``responses``/``response_lengths``/``texts`` are arrays of ``num_signatures``
entries (always arrays, so the schema does not change with a parameter); the
scalar columns are their first element. Rows whose response has no token are
kept with ``status = 'empty_response'`` so they can be counted, and left out by
``valid_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksmith.functions.keyed import bucket
from marksmith.functions.text import (
    EOS, decode_tokens, has_token, has_token_after_strip, leading_tokens, strip_punct, tokens, window_start,
)
from marksmith.operators.joins import lookup_join
from marksmith.operators.position import placed, with_position
from marksmith.operators.records import check_cardinality, resolve_strategy, split_start

# Cyclic pairing stride, window search width and maximal offset.
CYCLE_STRIDE = 1024
WINDOW_TRIES = 20
WINDOW_MAX_OFFSET = 10


def truncated_key(key: Column, max_key_length: int):
    """Keep the first ``max`` tokens only when the key is longer.

    Returns (key string, kept tokens, key_length)."""
    toks = leading_tokens(key, max_key_length)
    kept = F.slice(toks, 1, max_key_length)
    key_out = F.when(F.size(toks) > max_key_length, decode_tokens(kept)).otherwise(key)
    return key_out, kept, F.least(F.size(toks), F.lit(max_key_length))


def single_window(resp_tokens: Column, width: int) -> Column:
    """E5 for one signature: ``width`` tokens from ``min(10, L-width)``; the whole
    response when it is shorter than the window."""
    n = F.size(resp_tokens)
    start = window_start(n, width, WINDOW_MAX_OFFSET)
    return F.when(n >= width, F.slice(resp_tokens, start + 1, width)).otherwise(resp_tokens)


def distinct_windows(sig_tokens: Column, width: int) -> Column:
    """E5 for several signatures of one row: signature ``i`` takes the first of
    20 successive windows whose text is not already used by signatures ``< i``;
    if none qualifies, the whole response."""

    def step(acc, rt):
        n = F.size(rt)
        start = window_start(n, width, WINDOW_MAX_OFFSET)
        used = F.transform(acc, lambda a: F.array_join(a, " "))
        cands = F.transform(
            F.sequence(F.lit(0), F.lit(WINDOW_TRIES - 1)),
            lambda s: F.when((start + s >= 0) & (start + s + width <= n),
                             F.slice(rt, start + s + 1, width)),
        )
        free = F.filter(cands, lambda w: w.isNotNull() & ~F.array_contains(used, F.array_join(w, " ")))
        return F.concat(acc, F.array(F.coalesce(F.get(free, 0), rt)))

    return F.aggregate(sig_tokens, F.array().cast("array<array<string>>"), step)


def searched_tokens(resp_tokens: Column, width: int, num_signatures: int) -> Column:
    """The leading tokens that ``distinct_windows`` searches, which give the same windows; all
    tokens where the whole response may be taken. Earlier signatures use up at most
    ``num_signatures - 1`` texts, so one of that many windows with distinct texts and one more
    is always free."""
    most = WINDOW_MAX_OFFSET + WINDOW_TRIES - 1 + width
    texts = F.transform(F.sequence(F.lit(1), F.lit(WINDOW_TRIES)), lambda s: F.array_join(
        F.slice(resp_tokens, F.lit(WINDOW_MAX_OFFSET) + s, width), " "))
    enough = F.size(F.array_distinct(texts)) >= num_signatures
    return F.when((F.size(resp_tokens) > most) & enough,
                  F.slice(resp_tokens, 1, most)).otherwise(resp_tokens)


def with_eos(toks: Column) -> Column:
    """Append the end marker unless it is already last."""
    return F.when(F.try_element_at(toks, F.lit(-1)) == F.lit(EOS), toks).otherwise(
        F.concat(toks, F.array(F.lit(EOS))))


def prepare_pairs(cache: DataFrame, strategy: str, num_signatures: int, width: int,
                  max_key_length: int, whitespace_to_space: bool = False) -> DataFrame:
    """Per-row narrow columns, computed before anything is positioned or shuffled:
    the key (E3), its kept tokens and length, and either the chosen response
    window (one signature) or the response tokens that several signatures search for
    distinct windows: all of them only where the whole response may be taken."""
    key_out, kept, key_len = truncated_key(F.col("key"), max_key_length)
    extra = [c for c in cache.columns if c not in ("key", "response")]
    if strategy == "inverse_nucleus":
        rt = tokens(F.col("response"))
    else:
        rt = tokens(strip_punct(F.col("response"), whitespace_to_space))
    cols = [key_out.alias("key"), kept.alias("_kept"), key_len.alias("key_length")]
    if num_signatures == 1 and strategy in ("english", "random_word"):
        cols.append(single_window(rt, width).alias("_own"))
        cols.append(has_token_after_strip(F.col("response")).alias("_nonempty"))
    elif num_signatures == 1 and strategy == "inverse_nucleus":
        cols.append(rt.alias("_own"))
        cols.append(has_token(F.col("response")).alias("_nonempty"))
    elif strategy == "inverse_nucleus":
        cols.append(rt.alias("_rt"))
    elif num_signatures == 1:
        cols.append(single_window(rt, width).alias("_rt"))
    else:
        # tokens in a projection of their own: the search refers to them many times
        cache = cache.withColumn("_tokens", rt)
        cols.append(searched_tokens(F.col("_tokens"), width, num_signatures).alias("_rt"))
        cols += [F.col("_tokens").alias("_whole"), F.col("response").isNull().alias("_null")]
    return cache.select(*extra, *cols)


def _signature_sources(rows: DataFrame, strategy: str, num_signatures: int, total: int,
                       pool_total: int | None, seed: int) -> DataFrame:
    """(fp_id, sig, src) rows — one per signature, from another row."""
    sigs = rows.select(F.col("pos").alias("fp_id"),
                       F.explode(F.sequence(F.lit(0), F.lit(num_signatures - 1))).alias("sig"))
    if strategy == "english_random_responses":
        target = bucket(seed, F.col("fp_id"), F.col("sig"), n=F.lit(pool_total))
    else:
        target = F.pmod(F.col("fp_id") + F.lit(CYCLE_STRIDE) * F.col("sig"), F.lit(total))
    return sigs.withColumn("src", target)


def _source_tokens(sigs: DataFrame, source: DataFrame, column: str) -> DataFrame:
    """(fp_id, sigs): the tokens of each signature's source, in order."""
    # one shuffle equi-join on an integer position; neither side is broadcast
    srcs = sigs.join(source.select(F.col("pos").alias("src"), F.col(column).alias("_rt")), "src").drop("src")
    # each group holds num_signatures rows: bounded
    return srcs.groupBy("fp_id").agg(F.array_sort(F.collect_list(F.struct("sig", "_rt"))).alias("sigs"))


def _searched_sources(sigs: DataFrame, source: DataFrame) -> DataFrame:
    """``_source_tokens`` of what the search looks at. Beside a null response the others are taken
    whole, so fingerprints with one (only these) get all tokens."""
    nulls = source.filter("_null").select(F.col("pos").alias("src"))
    if nulls.isEmpty():
        return _source_tokens(sigs, source, "_rt")
    odd = sigs.join(nulls, "src").select("fp_id").distinct().checkpoint(eager=True)
    odd_sigs = lookup_join(sigs, odd, ["fp_id"], "left_semi")
    asked = odd_sigs.select(F.col("src").alias("pos")).distinct()
    return _source_tokens(lookup_join(sigs, odd, ["fp_id"], "left_anti"), source, "_rt").unionByName(
        _source_tokens(odd_sigs, lookup_join(source.select("pos", "_whole"), asked, ["pos"], "left_semi"), "_whole"))


def assemble_registry(cache: DataFrame, num_fingerprints: int | None = None, *,
                      data_split: float = 0, max_key_length: int = 16,
                      response_length: int = 1, strategy: str = "english",
                      num_signatures: int = 1, pool: DataFrame | str | None = None,
                      seed: int = 42, whitespace_to_space: bool = False,
                      order: list | None = None, total: int | None = None) -> DataFrame:
    """Build fingerprint rows (E3-E7 over D1-D3) from a pair set.

    ``cache`` holds ``key``, ``response`` and either a dense ``pos`` or the
    ``order`` columns (best a unique key) to position it by; positions are then taken
    over the key columns alone and joined to the narrow prepared rows, never
    over raw texts. ``pool='self'`` draws random responses from the pair set.
    """
    strategy = resolve_strategy(strategy, response_length, has_cache=True)
    prep_args = dict(strategy=strategy, num_signatures=num_signatures, width=response_length,
                     max_key_length=max_key_length, whitespace_to_space=whitespace_to_space)
    prepared = prepare_pairs(cache, **prep_args)
    if "pos" not in cache.columns:
        if not order:
            raise ValueError("a pair set without pos needs the order columns to position it")
        positions = with_position(cache.select(*order), list(order))
        total = positions.count() if total is None else total  # cheap: key-only checkpoint
        prepared = placed(prepared, positions, list(order))
    total = prepared.count() if total is None else total
    n = total if num_fingerprints is None else num_fingerprints
    check_cardinality(total, n, data_split)
    start = split_start(data_split, n)
    rows = prepared.filter(F.col("pos").between(start, start + n - 1))
    pool_total = None
    if strategy == "english_random_responses":
        if pool is None:
            raise ValueError("random responses need a response pool")
        if isinstance(pool, str) and pool == "self":
            pool, pool_total = prepared, total
        else:
            pool = prepare_pairs(pool.withColumn("key", F.lit("")), **prep_args)
            pool_total = pool.count()

    keyed = rows.select(F.col("pos").alias("fp_id"), "key", "_kept", "key_length")
    if "_own" in prepared.columns:
        # the row's own response: one projection, no join, no shuffle
        out = rows.select(F.col("pos").alias("fp_id"), "key", "_kept", "key_length",
                          F.array("_own").alias("chosen"), "_nonempty")
    else:
        sigs = _signature_sources(rows, strategy, num_signatures, total, pool_total, seed)
        source = pool if strategy == "english_random_responses" else prepared
        grouped = _searched_sources(sigs, source) if "_whole" in source.columns else \
            _source_tokens(sigs, source, "_rt")
        raw = F.transform(F.col("sigs"), lambda s: s["_rt"])
        if strategy == "inverse_nucleus":
            chosen = raw
        elif num_signatures == 1:
            chosen = F.transform(raw, lambda t: single_window(t, response_length))
        else:
            chosen = distinct_windows(raw, response_length)
        out = keyed.join(grouped.select("fp_id", chosen.alias("chosen")), "fp_id")

    if "_nonempty" in out.columns:
        # the same verdict from a cheap test on the raw text (see has_token_after_strip)
        status = F.when(F.col("_nonempty"), F.lit("ok")).otherwise(F.lit("empty_response"))
    else:
        status = F.when(F.exists("chosen", lambda t: F.size(t) == 0), F.lit("empty_response")) \
            .otherwise(F.lit("ok"))
    finals = F.transform(F.col("chosen"), with_eos)
    out = out.withColumn("_final", finals)
    out = out.select(
        "fp_id", "key", "key_length",
        F.transform("_final", decode_tokens).alias("responses"),
        F.transform("_final", lambda t: F.size(t).cast("int")).alias("response_lengths"),
        F.transform("_final", lambda t: decode_tokens(F.concat(F.col("_kept"), t))).alias("texts"),
        status.alias("status"),
    )
    return out.select(
        "fp_id", "key", F.col("key_length").cast("int").alias("key_length"),
        F.get("responses", 0).alias("response"),
        F.get("response_lengths", 0).alias("response_length"),
        F.get("texts", 0).alias("text"),
        "responses", "response_lengths", "texts", "status",
    )


def valid_rows(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status") == "ok")


def exploded_signatures(registry: DataFrame) -> DataFrame:
    """One row per (fingerprint, signature)."""
    return registry.select(
        "fp_id", "key", "key_length", "status",
        F.posexplode(F.arrays_zip("responses", "response_lengths", "texts")).alias("sig", "z"),
    ).select("fp_id", "sig", "key", "key_length", F.col("z.responses").alias("response"),
             F.col("z.response_lengths").alias("response_length"), F.col("z.texts").alias("text"),
             "status")
