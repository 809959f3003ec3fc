"""Steps rewritten to move less: the same rows as the plain way, from less that is moved."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marksmith.functions.text import tokens
from marksmith.functions.text import leading_tokens
from marksmith.operators import distrib, pairing, pairs, subword


def pairs_of(text):
    toks = (text or "").split()
    return list(zip(toks, toks[1:]))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("head_rows", [0, 2, 1000])
def test_nll_equals_the_formula(spark, monkeypatch, head_rows):
    """repeated and null ids, pairs and contexts that the model lacks; totals that are
    broadcast, looked up, and both."""
    monkeypatch.setattr(distrib, "HEAD_ROWS", head_rows)
    corpus = ["a b a b c", "b c d a b", "a a a", "c", None]
    texts = [(1, "a b c d"), (1, "a b"), (None, "a x a b"), (2, "x y"), (3, "a"), (4, None), (5, "d a b " * 20)]
    n = Counter(p for t in corpus for p in pairs_of(t))
    total = Counter()
    for (ctx, _), c in n.items():
        total[ctx] += c
    sums = defaultdict(list)
    for key, text in texts:
        for ctx, token in pairs_of(text):
            sums[key].append(-math.log((n[ctx, token] + 1) / (total[ctx] + 4)))
    counts = distrib.bigram_counts(spark.createDataFrame([(t,) for t in corpus], "text string"))
    got = distrib.shifted_nll(spark.createDataFrame(texts, "id long, text string"), "id", counts, 4).collect()
    assert len(got) == len(sums)
    for row in got:
        assert row.n_predicted == len(sums[row.id])
        assert row.nll == pytest.approx(sum(sums[row.id]) / len(sums[row.id]), abs=1e-6)


def test_least_of_head_bounds_the_rows(spark):
    table = spark.createDataFrame([(w,) for w in [1, 1, 1, 2, 3, 4, 9, 9]], "w long")
    for rows in range(9):
        least = distrib._least_of_head(table, "w", rows)
        assert table.filter(F.col("w") >= least).count() <= rows
    assert distrib._least_of_head(table, "w", 8) == 1 and distrib._least_of_head(table, "w", 4) == 4


def test_bigrams_of_asked_contexts(spark):
    """other contexts are dropped, asked ones keep all their pairs."""
    texts = spark.createDataFrame([("a b a c b a",), (None,), ("b",)], "text string")
    only = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "ctx string")
    got = distrib.bigram_counts(texts, only=only).collect()
    assert sorted(map(tuple, got)) == [("a", "b", 1), ("a", "c", 1)]


def test_outside_nucleus_of_short_and_long_contexts(spark):
    """contexts above the bound go by segments, the others by one window, with equal rows."""
    rows = [(f"c{g}", t, (i * 7) % 5 + 1) for g in range(9) for i, t in enumerate([*"abcdefgh", ",", "x."][: g + 1])]
    counts = spark.createDataFrame(rows, "ctx string, token string, n long")
    whole = distrib.outside_nucleus(counts, 0.8)
    mixed = distrib.outside_nucleus(counts, 0.8, single_task_rows=5)
    assert "Join" not in plan(whole)
    assert whole.columns == mixed.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, mixed.collect()))


def test_kgrams_of_asked_contexts(spark):
    """positions are left out first by the last token of the contexts asked for."""
    texts = spark.createDataFrame([("a b c a b d",), ("b",), (None,), ("b c",)], "text string")
    only = spark.createDataFrame([("a b",), ("q c",), ("",)], "ctx string")
    got = sorted(map(tuple, distrib.kgram_counts(texts, 3, only=only, empty=False).collect()))
    assert got == [("a b", "c", 1), ("a b", "d", 1)]
    every = {r.token: r.n for r in distrib.kgram_counts(texts, 3, only=only).filter("ctx = ''").collect()}
    assert every == {"a": 2, "b": 4, "c": 2, "d": 1}


def test_equal_texts_of_a_row_are_encoded_once():
    """F5."""
    class Words:
        calls = Counter()

        def encode_batch_fast(self, texts, add_special_tokens):
            self.calls.update(texts)
            return [self.encode(t, add_special_tokens) for t in texts]

        def encode(self, text, add_special_tokens):
            return type("Encoding", (), {"ids": [int(w) for w in text.split()]})

        def decode(self, ids, skip_special_tokens):
            return " ".join(map(str, ids))

    text, tok = " ".join(map(str, range(14))), Words()
    assert subword.row_windows([text, text, None, "7"], 2, tok) == [
        (0, "10 11", 10, 2), (1, "11 12", 11, 2), (2, "", subword.WHOLE, 0), (3, "7", subword.WHOLE, 1)]
    assert tok.calls == {text: 1, "": 1, "7": 1}


def test_signatures_move_the_searched_tokens_only(spark):
    """Of a long response only the tokens that the search looks at, all of them where the
    whole response may be taken; the windows stay the same."""
    texts = ["w " * 50, "a b " * 30, " ".join(f"t{i}" for i in range(80)), " ".join(f"t{i}" for i in range(33)),
             "x " * 20 + " ".join(f"t{i}" for i in range(40)), "a b c", "", None]
    cache = spark.createDataFrame(list(enumerate(texts)), "pos long, text string").select(
        "pos", F.col("text").alias("key"), F.col("text").alias("response"))
    got = pairing.prepare_pairs(cache, "english", 3, 4, 16).select("pos", "_rt")
    sizes = {r["pos"]: None if r["_rt"] is None else len(r["_rt"]) for r in got.collect()}
    assert sizes == {0: 50, 1: 60, 2: 33, 3: 33, 4: 33, 5: 3, 6: 0, 7: None}
    both = got.join(cache, "pos").select("pos", "_rt", tokens(F.col("response")).alias("_all"))
    for other in range(6):
        first = both.filter(F.col("pos") == other).select(F.col("_rt").alias("o_rt"), F.col("_all").alias("o_all"))
        x = both.filter("pos < 6").crossJoin(first)
        cut = pairing.distinct_windows(F.array("o_rt", "_rt", "_rt"), 4)
        whole = pairing.distinct_windows(F.array("o_all", "_all", "_all"), 4)
        assert x.filter(~cut.eqNullSafe(whole)).count() == 0


def test_signatures_beside_a_null_response_are_whole(spark):
    """A null source hides the windows of the later signatures, which stay whole."""
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(i, None if i == 1030 else long) for i in range(2100)]
    cache = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", F.col("text").alias("key"), F.col("text").alias("response"))
    reg = pairing.assemble_registry(cache, order=["doc_id"], response_length=4, num_signatures=3)
    got = {r.fp_id: r.responses for r in reg.filter("fp_id in (5, 6)").collect()}
    assert got[5] == [f"t{i} t{i + 1} t{i + 2} t{i + 3} </s>" for i in (10, 11, 12)]
    assert got[6][0] == "t10 t11 t12 t13 </s>" and got[6][1] is None and got[6][2] == f"{long} </s>"


ODD_TEXTS = [" a b\ta\x0bb\n", None, "", " ", "c\u00a0d e\x1cf", "a b c a b", "lone", "x " * 300 + "y", "\u00e9t\u00e9 a b"]


def java_tokens(text):
    """The white space of the engine's tokens: six ASCII characters."""
    return [t for t in "".join(" " if c in "\t\n\x0b\f\r" else c for c in text or "").split(" ") if t]


def test_chunk_tokens_are_the_tokens_of_the_engine(spark):
    """the same white space, empty and null texts, and texts of one token."""
    vocab, codes, sizes = pairs.encode(pa.array(ODD_TEXTS))
    words = [w.decode() for w in vocab.to_pylist()]
    split = np.split(np.array([words[c] for c in codes], object), np.cumsum(sizes)[:-1])
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id int, text string")
    engine = {r.id: r.t or [] for r in df.select("id", tokens("text").alias("t")).collect()}
    assert [list(s) for s in split] == [java_tokens(t) for t in ODD_TEXTS] == [engine[i] for i in range(len(ODD_TEXTS))]
    every = {r.token for r in pairs.distinct_tokens(df).collect()}
    assert every == {t for text in ODD_TEXTS for t in java_tokens(text)}


@pytest.mark.parametrize("chunk, bucket", [(1, 1), (40, 64), (1 << 20, 1 << 20)])
def test_pairs_by_chunks_equal_all_pairs(spark, monkeypatch, chunk, bucket):
    """one chunk or one for each text, few or many buckets."""
    monkeypatch.setattr(pairs, "BUCKET_BYTES", bucket)
    df = spark.createDataFrame([(t,) for t in ODD_TEXTS], "text string").coalesce(2)
    want = Counter(p for t in ODD_TEXTS for p in zip(java_tokens(t), java_tokens(t)[1:], strict=False))
    batches = pa.RecordBatch.from_arrays([pa.array(ODD_TEXTS)], ["text"])
    weights = np.array([len((t or "").encode()) for t in ODD_TEXTS])
    cut = list(pairs.chunked(iter([batches, batches]), lambda b: weights, chunk))
    assert [t for c in cut for t in c.column("text").to_pylist()] == ODD_TEXTS * 2
    assert all(len(c) == 1 or sum(len((t or "").encode()) for t in c.column("text").to_pylist()) <= chunk for c in cut)
    assert {(r.ctx, r.token): r.n for r in distrib.bigram_counts(df).collect()} == want
    only = spark.createDataFrame([("a",), (None,), ("x",)], "ctx string")
    few = {p: n for p, n in want.items() if p[0] in "ax"}
    assert {(r.ctx, r.token): r.n for r in distrib.bigram_counts(df, only=only).collect()} == few
    monkeypatch.setattr(distrib, "MAX_ASKED_BYTES", 0)
    assert {(r.ctx, r.token): r.n for r in distrib.bigram_counts(df, only=only).collect()} == few


def test_blobs_give_back_their_pairs():
    """sorted pairs with their counts, in buckets, and the same keys over one vocabulary."""
    rng = np.random.default_rng(1)
    vocab = pa.array([f"w{i}".encode() for i in range(400)] + [b""])
    keys, n = pairs.distinct((rng.integers(0, 20, 5000) << 32) | rng.integers(0, 400, 5000))
    keys = pairs.with_totals(keys, len(vocab))
    n = np.arange(len(keys)) * 300
    got = {}
    parts = [pairs.unpack(blob) for _, blob in pairs.blobs(vocab, keys, n, 16)]
    words, united = pairs.united(parts)
    for part, (_, ints) in zip(united, parts, strict=True):
        for key, count in zip(part.tolist(), ints[2].tolist(), strict=True):
            got[words[key >> 32].as_py(), words[key & 0xFFFFFFFF].as_py()] = count
    assert got == {(vocab[k >> 32].as_py(), vocab[k & 0xFFFFFFFF].as_py()): c
                   for k, c in zip(keys.tolist(), n.tolist(), strict=True)}
    every, total = pairs.summed(united + united, [i[2] for _, i in parts] * 2)
    assert len(every) == len(keys) and total.sum() == 2 * n.sum()


def test_occurrences_of_a_pair_do_not_move(spark):
    """texts are not exploded into rows for the look-up; repeats of a pair add nothing."""
    for times in (2, 400):
        df = spark.createDataFrame([(i, "a b c d " * times) for i in range(40)], "id int, text string")
        out = distrib.shifted_nll(df, "id", distrib.bigram_counts(df), 4)
        assert {r.n_predicted for r in out.collect()} == {4 * times - 1}
        assert "explode" not in plan(out) and "SortMergeJoin" not in plan(out)


def test_leading_tokens_are_the_first_tokens(spark):
    """keys are split only as far as they are kept."""
    df = spark.createDataFrame([(t,) for t in ODD_TEXTS + [" a b c d ", "a b c", "a b c ", "a b c d e"]], "text string")
    for n in (1, 2, 3, 4):
        cut, whole = F.slice(leading_tokens("text", n), 1, n), F.slice(tokens("text"), 1, n)
        assert df.filter(~cut.eqNullSafe(whole)).count() == 0
        assert df.filter(~F.least(F.size(leading_tokens("text", n)), F.lit(n + 1)).eqNullSafe(
            F.least(F.size(tokens("text")), F.lit(n + 1)))).count() == 0



def test_attempts_of_few_keys_are_dealt_out(spark, monkeypatch):
    """the unresolved keys of a round lie in one partition, their attempts do not."""
    tasks, lookup = [], distrib.lookup_join

    def watched(probe, *args, **kwargs):
        if "j" in probe.columns:
            tasks.append(probe.rdd.getNumPartitions())
        return lookup(probe, *args, **kwargs)

    monkeypatch.setattr(distrib, "lookup_join", watched)
    rows = [("a", "," if i < 150 else "z", i, i >= 150, 0 if i >= 150 else None) for i in range(151)]
    cands = spark.createDataFrame(rows, "ctx string, token string, cand_rank long, alnum boolean, alnum_rank long")
    keys = spark.createDataFrame([(i, "a") for i in range(6)], "fp_id long, ctx string").coalesce(1)
    got = distrib.inverse_nucleus_pick(keys, cands, 3, 42, attempts_per_round=4).collect()
    assert {(r.fp_id, r.token, r.status) for r in got} == {(i, "z", "ok") for i in range(6)}
    assert len(tasks) > 2 and set(tasks) == {int(spark.conf.get("spark.sql.shuffle.partitions"))}
