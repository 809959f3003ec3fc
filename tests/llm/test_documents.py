"""Operators over documents against brute-force versions on small, awkward inputs."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marksmith.llm import (decontamination, exact_dedup, language_id, near_join, personal_data,
                           sentencepiece_codec, substring_dedup, token_counts)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _t string, "
          "digest string, key string, th long, _row string")
LINE = "the quick brown fox jumps over the lazy dog while seven other animals watch from the hill"
LONG = " ".join(f"word{i % 37}x{i // 5}" for i in range(3000))
TEXTS = [
    (1, LINE + " and " + LINE), (2, LINE + " and " + LINE), (3, None), (4, ""), (5, "!!! ... 123"),
    (6, LONG), (7, LONG), (7, LONG), (None, LONG), (8, "a" * 70_000), (9, "x" * 300 + " " + LONG),
    (10, "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn"),
    (11, "Mail a.b@example.org or call +49 (30) 1234-5678, card 4111 1111 1111 1111 at 10.0.0.255"),
    (12, LONG.replace("word5x1 ", "changed ")), (13, " \n two  spaces\n▁ mark \t tab "),
    (7, "another text under a used id"), (14, "Ating. " * 60), (15, "a b c"), (16, "a b c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de" if i == 10 else "en" if t else None, "s", len(t or ""), "clash", "clash",
             "clash", 5, "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sentencepiece_equals_library(docs, none):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    got = sentencepiece_codec.encode_decode(docs, sentencepiece_codec.default_model())
    want = [(i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in TEXTS]
    assert by_id(got) == sorted(want, key=repr)
    assert sentencepiece_codec.encode_decode(none, sentencepiece_codec.default_model()).count() == 0


def test_sentencepiece_table_of_distinct_chunks(docs, none, monkeypatch):
    model = sentencepiece_codec.default_model()
    texts = docs.select(F.coalesce("text", F.lit("")).alias("_t"))
    cut = sentencepiece_codec.ChunkCodec.chunks
    want = {c for r in texts.collect() for c in cut(r["_t"])}
    rows = sentencepiece_codec.chunk_table(texts, model).collect()
    assert sorted(r["chunk"] for r in rows) == sorted(
        c for c in want if len(c) <= sentencepiece_codec.LONGEST_REMEMBERED)
    whole = by_id(sentencepiece_codec.encode_decode(docs, model))
    # a bounded table, an empty one and none at all give the same rows
    for most in (len(rows) // 2, 0):
        monkeypatch.setattr(sentencepiece_codec, "MAX_TABLE_CHUNKS", most)
        assert sentencepiece_codec.chunk_table(texts, model).count() <= most
        assert by_id(sentencepiece_codec.encode_decode(docs, model)) == whole
    monkeypatch.setattr(sentencepiece_codec.ChunkCodec, "_chunks_are_independent", lambda self: False)
    sentencepiece_codec._codec.cache_clear()
    assert by_id(sentencepiece_codec.encode_decode(docs, model)) == whole
    sentencepiece_codec._codec.cache_clear()
    assert sentencepiece_codec.chunk_table(none.select(F.col("text").alias("_t")), model).count() == 0


def test_sentencepiece_edges_and_small_table(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "TABLE_CHUNKS", 3)
    codec = sentencepiece_codec.ChunkCodec(sentencepiece_codec.default_model())
    assert codec.split
    texts = ["", " ", "  ", "\n", " \n ", "▁▁a", "\x00 a", "日本 語", "<s> <unk> <0x0A>", "ﬁ é",
             " " * 40 + "x" + " " * 33, "a\r\n b\n\n  c"] * 2
    ids, back = codec.run(texts)
    for t, i, b in zip(texts, ids, back, strict=True):
        want = codec.sp.encode(t)
        assert list(memoryview(i).cast("i")) == want and b == codec.sp.decode(want)


def test_token_counts_equal_library(docs, none):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_counts.default_file())
    got = token_counts.count_tokens(docs, token_counts.default_file(), huge_chars=5000, chunk=1500,
                                    overlap=20)
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids),
             n > 2048) for i, t in TEXTS]
    assert by_id(got) == sorted(want, key=repr)
    assert token_counts.count_tokens(none, token_counts.default_file()).count() == 0


def test_word_counts_of_marks_and_special_strings():
    counter = token_counts.WordCounter(token_counts.default_file())
    for t in ["don't I'LL he'S", "a<|endoftext|>b <|startoftext|>", "x\x1c!\x1c!y", "ΣΑΣ é",
              "word,, (word) word's' 12a3", "\x85x　y"]:
        assert counter.count([t]) == [len(counter.encode([t])[0].ids)]


def test_substring_dedup_equals_brute_force(spark, docs, none):
    rows = [(i, t) for i, t in TEXTS if i is not None and (i, t) != (7, "another text under a used id")]
    unique = dict(rows)
    first, want = {}, []
    for i in sorted(unique):
        words = (unique[i] or "").split()
        for s in range(len(words) - 19):
            first.setdefault(tuple(words[s:s + 20]), (i, s))
    for i in sorted(unique):
        words = (unique[i] or "").split()
        gone = set()
        for s in range(len(words) - 19):
            if first[tuple(words[s:s + 20])] != (i, s):
                gone |= set(range(s, s + 20))
        want.append((i, len(words), len(gone),
                     " ".join(x for k, x in enumerate(words) if k not in gone)))
    source = spark.createDataFrame(list(unique.items()), "doc_id long, text string").repartition(4)
    # the filters full, and the buckets' work spread in part and as a whole
    for more in ({"max_bits": 12}, {"bucket_windows": 40}, {"bucket_windows": 0}):
        assert by_id(substring_dedup.remove_repeats(source, **more)) == sorted(want, key=repr)
    # repeated ids: the same rows come back, and repeated rows agree
    again = substring_dedup.remove_repeats(docs)
    assert again.count() == len(TEXTS)
    assert again.filter("doc_id = 7").select("n_words", "n_removed").distinct().count() == 2
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_of_long_and_repetitive_texts(spark):
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, f"own{i} " * 3 + common + f" end{i} " + " ".join(f"u{i}x{j}" for j in range(25)))
            for i in range(40)]
    rows += [(100, "same " * 30_000), (101, " ".join(f"w{i}" for i in range(60_000))),
             (102, "x " * 10 + " ".join(f"w{i}" for i in range(30_000, 60_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {i: 60 if i else 0 for i in range(40)} | {100: 29_999, 101: 0, 102: 30_000}
    for bucket in (100, substring_dedup.BUCKET_WINDOWS):
        got = substring_dedup.remove_repeats(docs, bucket_windows=bucket).collect()
        assert {r["doc_id"]: r["n_removed"] for r in got} == want


def test_exact_dedup(spark, docs, none):
    got = exact_dedup.decide(docs, exact_dedup.DigestIndex(spark)).select(
        "doc_id", "keep_id", "group_size", "kept")
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in TEXTS:
        ids = groups[t or ""]
        keep = max(x for x in ids if x is not None)
        want.append((i, keep, len(ids), i == keep))
    assert by_id(got) == sorted(want, key=repr)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert kept.filter("digest = 'clash' and _row = 'clash'").count() == len(groups)
    assert exact_dedup.deduplicate(none).count() == 0


def test_first_batch_goes_through_the_index(spark):
    class Marked(exact_dedup.DigestIndex):
        def append(self, groups, attempt):
            super().append(groups.withColumn("group_size", groups["group_size"] + 100), attempt)

    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    index = Marked(spark, buckets=4)
    got = exact_dedup.decide(docs, index).select("doc_id", "keep_id", "group_size", "kept")
    assert by_id(got) == [(1, 2, 102, False), (2, 2, 102, True), (3, 3, 101, True)]
    new = exact_dedup.DigestIndex(spark, buckets=4)
    plan = new.unseen(exact_dedup.batch_groups(exact_dedup.digests(docs)), "a")
    assert plan.count() == 2 and new.table().count() == 0
    assert "SortMergeJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_digest_index_keeps_earlier_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "x"), (10, "z"), (11, None)], "doc_id long, text string")
    assert by_id(exact_dedup.deduplicate(a, index).select("doc_id")) == [(2,), (3,)]
    got = exact_dedup.decide(b, index).select("doc_id", "keep_id", "group_size", "kept")
    assert by_id(got) == [(10, 10, 1, True), (11, 11, 1, True), (9, 3, 2, False)]
    assert index.table().count() == 4


def test_digest_index_batch_again_and_after_a_failure(spark):
    class Failing(exact_dedup.DigestIndex):
        fail = False

        def commit(self, batch, attempt):
            if self.fail:
                raise RuntimeError("lost")
            super().commit(batch, attempt)

    index = Failing(spark, buckets=4)
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "x"), (10, "z"), (11, None)], "doc_id long, text string")

    def kept(docs, batch):
        return by_id(exact_dedup.deduplicate(docs, index, batch).select("doc_id"))

    assert kept(a, "a") == kept(a, "a") == [(2,), (3,)]
    index.fail = True
    with pytest.raises(RuntimeError, match="lost"):
        kept(b, "b")
    index.fail = False
    assert index.table().count() == 2 and spark.table(index.name).count() == 4
    assert kept(b, "b") == kept(b, "b") == [(10,), (11,)]
    assert kept(a, "a") == [(2,), (3,)]
    assert kept(b, "c") == [] and index.table().count() == 4
    index.compact()
    assert spark.table(index.name).count() == index.table().count() == 4
    assert kept(a, "a") == [(2,), (3,)] and kept(b, "d") == []
    index.drop()
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.deduplicate(a)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_tries_connect_what_all_pairs_connect():
    import numpy as np
    rnd = np.random.default_rng(7)
    for n, levels in [(1, 3), (40, 3), (200, 3), (60, 0), (90, 8)]:
        base = rnd.integers(0, 256, (max(1, n // 8), near_join.SKETCH), dtype=np.uint8)
        bits = base[rnd.integers(0, len(base), n)].copy()
        # a chain of drifting copies: only neighbours are plausible
        noise = rnd.random(bits.shape) < rnd.random((n, 1)) * 0.5
        bits[noise] = rnd.integers(0, 256, int(noise.sum()), dtype=np.uint8)
        top = 1 << (near_join.BRANCH_BITS * levels)
        branch = np.sort(rnd.integers(0, min(top, 1 << 20) if n != 90 else top - 1, n,
                                      dtype=np.uint64, endpoint=n == 90))
        want = near_join._Forest(n)
        for i in range(n):
            for j in range(i + 1, n):
                if (bits[i] == bits[j]).sum() >= near_join.PLAUSIBLE * near_join.SKETCH:
                    want.join(i, j)
        got = near_join.plausible_forest(branch, bits, levels)
        assert [got.root(i) for i in range(n)] == [want.root(i) for i in range(n)]
        assert len(got.edges()) == len(want.edges())


def test_prefixes_are_shortened_only_while_members_are_apart(monkeypatch):
    import numpy as np
    compared = []

    class Counted(np.ndarray):
        def __eq__(self, other):
            compared.append(len(self) if self.ndim > 1 else 1)
            return np.asarray(self) == np.asarray(other)

    same = np.zeros((30, near_join.SKETCH), dtype=np.uint8).view(Counted)
    near_join.plausible_forest(np.zeros(30, dtype=np.uint64), same, 3)
    # one run of whole labels links all: nothing is compared at a shorter prefix
    assert sum(compared) == 29
    assert near_join.shortest_depth() == 5 and near_join.shortest_depth(threshold=0.95) == 8


def jaccard_groups(rows, n=5):
    sets = []
    for i, t in rows:
        words = re.findall(r"[^\W_]+", (t or "").lower())
        size = min(n, len(words))
        sets.append((i, frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1))
                     if words else None))
    return sets


@pytest.mark.parametrize("tile", [256, 4])
def test_near_join_equals_all_pairs(spark, none, tile):
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(w if (j * 7 + k) % (61 + k) else "other" for j, w in enumerate(base)))
            for k in range(1, 30)]
    rows += [(100, None), (101, ""), (102, "a b"), (103, "A, b!"), (104, LINE), (105, LINE.upper())]
    source = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = jaccard_groups(rows)
    links = {i: {j for j, b in sets if j != i and a and b
                 and len(a & b) >= 0.8 * len(a | b)} for i, a in sets}

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    want = sorted((i, reach(i), len(links[i])) for i, _ in rows)
    got = near_join.judge(source, tile=tile).select("doc_id", "class_id", "n_links")
    assert by_id(got) == sorted(want, key=repr)
    assert sum(map(len, links.values())) > 60
    kept = near_join.one_of_each_group(source)
    assert sorted(r[0] for r in kept.collect()) == sorted({reach(i) for i, _ in rows})
    assert near_join.near_join(none).count() == 0


def test_near_join_rows_with_repeated_ids(docs):
    kept = near_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(7) == 1 and 6 in ids and 12 not in ids and None not in ids
    assert {3, 4, 15} <= set(ids) and 16 not in ids


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            new[j] = min(row[j - 1] + (p[i - 1] != t[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def test_decontamination_equals_full_alignment(spark, docs, none):
    import random
    rng = random.Random(5)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
                          for _ in range(rng.randrange(3, 22)))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "short")]
    rows = []
    for d in range(60):
        item = rng.choice(items[:12])[1]
        s, k = list(item), rng.randrange(0, decontamination.budget(len(item)) + 4)
        for _ in range(k):
            j = rng.randrange(len(s))
            s[j] = rng.choice(["x", "", "qz"])
        rows.append((d, "lorem, IPSUM!  " * 9 + "".join(s).upper() + " dolor (sit) amet" * 7))
    rows += [(90, None), (91, ""), (92, "short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    source = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    norm = decontamination.normalised
    want = []
    for d, t in rows:
        for i, q in items:
            p = norm(q or "")
            if len(p) >= decontamination.Q:
                e = edit_distance(p, norm(t or ""))
                if e <= decontamination.budget(len(p)):
                    want.append((d, i, e))
    got = decontamination.matches(source, bench).select("doc_id", "item_id", "edits")
    assert by_id(got) == sorted(want, key=repr) and 20 < len(want) < 60
    clean = decontamination.clean_documents(source, bench)
    assert sorted(r[0] for r in clean.collect()) == sorted(
        {d for d, _ in rows} - {w[0] for w in want})
    assert decontamination.clean_documents(docs, bench).columns == docs.columns
    assert decontamination.matches(none, bench).count() == 0
    assert decontamination.matches(source, bench.limit(0)).count() == 0


def test_decontamination_in_several_blocks_and_parts(spark):
    long_item = LONG[:1500]
    bench = spark.createDataFrame([(1, long_item), (2, LINE)], "item_id long, text string")
    blocks = list(decontamination.blocks(bench, block_bytes=600))
    assert len(blocks) > 2 and all(sum(map(len, b.patterns)) <= 1100 for b in blocks)
    source = spark.createDataFrame([(1, "zz " * 50 + LONG[300:1200]), (2, "clean " * 80)],
                                   "doc_id long, text string")
    assert [r[:2] for r in by_id(decontamination.matches(source, bench))] == [(1, 1)]


def test_decontamination_of_huge_and_repetitive_texts(spark, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(4000)]
    item, other = " ".join(rng.choices(words, k=40)), " ".join(rng.choices(words, k=30))
    filler = " ".join(rng.choices(words, k=300_000))
    size = decontamination.SCAN_BYTES
    # the item lies across the end of the first piece
    huge = filler[:size - 60] + " " + item + " " + filler[size:]
    texts = [huge, filler, "a" * 400_000, "x " * 300_000, other + " " + "a" * 99, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other), (3, "a" * 300)], "item_id long, text string")
    want = [(0, 1), (2, 3), (4, 2)]
    assert [r[:2] for r in by_id(decontamination.matches(docs, bench))] == want
    index = next(decontamination.blocks(bench))
    one = index.search(decontamination.normalised(huge) + b"\0" * 8, np.array([0, len(huge) + 8]))
    # the pieces change nothing
    for scan, rows in ((1000, 4_000_000), (1 << 20, 50), (777, 60)):
        monkeypatch.setattr(decontamination, "SCAN_BYTES", scan)
        monkeypatch.setattr(decontamination, "HIT_ROWS", rows)
        buf = decontamination.normalised(huge)[size - 20_000:size + 20_000] + b"\0" * 8
        got = index.search(buf, np.array([0, len(buf)]))
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in one.items()}


def test_clean_documents_in_several_blocks(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(4000)]
    items = [" ".join(rng.choices(words, k=30)) for _ in range(6)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(40)]
    texts = [t + " " + items[i % 6] if i % 5 == 0 else t for i, t in enumerate(texts)] + [None, "", ""]
    docs = spark.createDataFrame([(i, t, "d", "r") for i, t in enumerate(texts)],
                                 "doc_id long, text string, digest string, _row string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = [i for i in range(len(texts)) if i >= 40 or i % 5]
    for size in (200, 400, 4_000_000):
        clean = decontamination.clean_documents(docs, bench, block_bytes=size)
        assert clean.columns == docs.columns
        assert sorted(r["doc_id"] for r in clean.collect()) == want


def test_language_id_held_out_and_edges(spark, docs, none):
    import random
    rng = random.Random(3)
    words = {"en": "the of and to in that it is was for with this from are".split(),
             "de": "der die und das nicht ein ist zu den von mit sich auf für".split(),
             "fr": "le la les des et une est pour dans que qui pas sur avec".split()}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(30)), lang)
            for k, lang in enumerate(list(words) * 40)]
    rows += [(500, None, "en"), (501, "123 !!", "de"), (502, "le la les", None)]
    source = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(source)
    assert model.langs == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in language_id.identify(source, model).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows[:120])
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[500]["score"] == 0
    assert got[502]["lang_pred"] == "fr" and all(0 <= r["score"] <= 1 for r in got.values())
    held = {r["doc_id"] for r in source.filter(language_id.held_out()).collect()}
    import zlib
    assert held == {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    # the held-out fold teaches nothing
    lied = source.withColumn("lang", F.when(language_id.held_out(), "xx").otherwise(F.col("lang")))
    assert language_id.fit(lied).langs == model.langs
    kept = language_id.known_language(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for _, t in TEXTS if t and re.search(r"[^\W\d_]", t))
    assert language_id.identify(none, language_id.fit(none)).count() == 0


def plain_grams(text):
    """Hashed n-grams of lengths 1 to 4, one at a time."""
    low = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode())
    framed, mask, out = b" " + b" ".join(low.split()) + b" ", 0xFFFFFFFF, []
    for n in range(1, 5):
        for i in range(len(framed) - n + 1):
            code = 0
            for c in framed[i:i + n]:
                code = (code << 8 | c) & mask
            salted = (code ^ (n * 0x3C6EF372 & mask)) * 0x9E3779B1 & mask
            out.append(((salted ^ salted >> 15) * 0x85EBCA6B & mask) >> 16)
    return out


def test_language_id_equals_plain_decoding(spark):
    rng = random.Random(3)
    stems = {"de": "der die das und nicht ein mit", "en": "the a of and not one with",
             "fr": "le la les et pas un avec", "es": "el los las y no uno con"}
    texts = [(i, lang, " ".join(rng.choices(stems[lang].split(), k=rng.randrange(1, 12))))
             for i, lang in enumerate(rng.choices(list(stems), k=80))]
    texts += [(100 + i, None, " ".join(rng.choices(" ".join(stems.values()).split(), k=6))) for i in range(30)]
    texts += [(200, "de", None), (201, "xx", "1 2 3"), (202, None, "Ünïcode ß"), (203, "en", "")]
    source = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    model = language_id.fit(source)
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["ambiguous"])
           for r in language_id.identify(source, model).collect()}
    learned = [(lang, t) for i, lang, t in texts if zlib.crc32(str(i).encode()) % 4 != 2
               and lang and t and any(c.isalpha() for c in t)]
    langs = sorted({lang for lang, _ in learned})
    assert model.langs == langs == sorted(stems)
    counts = {lang: collections.Counter() for lang in langs}
    for lang, t in learned:
        counts[lang].update(plain_grams(t))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=len(langs) - 1) if -1 in rest]
    floor = language_id.SMOOTHING / max(total.values())

    def share(gram, split, sign):
        side = [lang for lang, s in zip(langs, split, strict=True) if s == sign]
        return sum(counts[lang][gram] / total[lang] for lang in side) / len(side) + floor

    @functools.cache
    def weight(gram, b):
        ratio = math.log(share(gram, splits[b], 1) / share(gram, splits[b], -1))
        return max(-4.0, min(4.0, ratio))

    bits = range(len(splits))
    mean = {lang: [sum(n * weight(g, b) for g, n in counts[lang].items()) / total[lang] for b in bits]
            for lang in langs}
    trust = [max(min(mean[lang][b] * splits[b][k] for k, lang in enumerate(langs)), 0) + 1e-3 for b in bits]
    trust = [t / sum(trust) for t in trust]
    scale = 1 / (sum(abs(m) for ms in mean.values() for m in ms) / (len(langs) * len(splits)))
    for i, _, t in texts:
        if not t or not any(c.isalpha() for c in t):
            assert got[i][:2] == ("und", 0.0)
            continue
        found = plain_grams(t)
        margin = [sum(weight(g, b) for g in found) / len(found) for b in bits]
        loss = [sum(trust[b] * math.log1p(math.exp(-4 * scale * margin[b] * splits[b][k])) for b in bits)
                for k in range(len(langs))]
        order = sorted(range(len(langs)), key=loss.__getitem__)
        gap = loss[order[1]] - loss[order[0]]
        assert got[i][1] == pytest.approx(1 / sum(math.exp(-8 * (x - min(loss))) for x in loss), abs=1e-4)
        if gap > 1e-4:  # float32 weights may order nearly equal losses otherwise
            assert got[i][0] == langs[order[0]]
        if abs(gap - language_id.AMBIGUOUS_MARGIN) > 1e-4:
            assert got[i][2] == (gap < language_id.AMBIGUOUS_MARGIN)


def test_codewords_differ():
    for n in (1, 2, 4, 6, 40):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code}) == n


def plain_spans(t):
    def luhn(d):
        total = 0
        for i, c in enumerate(d[::-1]):
            x = int(c) * (1 + i % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    out = [("email", *m.span()) for m in
           re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19),
                                     ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if low <= len(d) <= high and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return out


def test_personal_data_base_spans(spark, docs, none):
    import random
    rng = random.Random(9)
    for _ in range(20000):
        t = "".join(rng.choice("a1@. +-()9Z%_:4é\n0") for _ in range(rng.randrange(40)))
        assert personal_data.base_spans(t) == plain_spans(t)
    found = personal_data.find_spans(docs, personal_data.learn(docs)).collect()
    assert len(found) == len(TEXTS)
    row = next(r for r in found if r["doc_id"] == 11)
    assert [(s["kind"], s["start"], s["end"]) for s in row["spans"] if s["base"]] == plain_spans(
        dict(TEXTS)[11])
    assert personal_data.find_spans(none, personal_data.learn(none)).count() == 0


def test_personal_data_adds_likely_spans(spark):
    rows = [(k, f"please call phone {200 + k} 555-{1000 + k} now") for k in range(40)]
    rows += [(100 + k, f"call +1 ({200 + k}) 555-{1000 + k} now") for k in range(40)]
    rows += [(200 + k, f"see version page {k + 10}.{k} and order key {1000 + k}-{k}") for k in range(40)]
    source = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in
             personal_data.find_spans(source, personal_data.learn(source)).collect()}
    assert all(found[100 + k][0]["base"] for k in range(40))
    assert all(len(found[k]) == 1 and not found[k][0]["base"] for k in range(40))
    assert not any(found[200 + k] for k in range(40))


def test_digests_of_queries(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a@b.c x", "en", "s", 7), (2, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in personal_data.op5_personal_data(spark, str(tmp_path)).collect()}
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:0:5").hexdigest()
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[2]["spans"] == ""
    kept = {r["doc_id"]: r for r in substring_dedup.op9_substring_dedup(spark, str(tmp_path)).collect()}
    assert kept[1]["kept_sha256"] == hashlib.sha256(b"a@b.c x").hexdigest()
