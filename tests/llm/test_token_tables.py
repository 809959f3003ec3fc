"""Filter audit, packing and tokenizer alignment against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from marksmith.llm import alignment, byte_bpe, filter_audit, packing

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, digest string, "
          "part string, rank string, uid string, h string, ids string")
LONG = " ".join(f"word{i % 37}x{i // 5}" for i in range(3000))
CLEAN = " ".join(f"plain{i}" for i in range(220))
TEXTS = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (3, None, None), (4, "", ""), (5, "A B C " * 90, "a"),
    (6, CLEAN, "a"), (7, CLEAN, None), (7, CLEAN + "!", None), (None, CLEAN, "b"), (None, None, "a"),
    (8, "x" * 70_000, "b"), (9, "costs $5\x85now\x0band\x1cthen", "a"), (10, CLEAN, "a"),
    (11, "ünï " * 300, "b"), (12, "a  b\n\n c▁d", "a"), (13, "<|endoftext|> <s> 日本語 😀", "b"),
    (14, " lead and trail \t ", "a"), (15, "!" * 3000 + " " * 2100 + "z", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, 0, *["clash"] * 6) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_audit(texts, labels):
    rows = [(i, t or "", s or "") for i, t, s in texts]
    failed = []
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        f += "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        f += "E" * any(t == u and j is not None and i is not None and j < i for j, u, _ in rows)
        failed.append(set(f))
    out = set()
    for part in {s for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, failed) if s == part]
        shapley = Counter(min(f, key=o.index) for o in permutations("ABCDE") for _, f in mine if f)
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [(i, f) for i, f in mine if x in f and not f & before]

                def lost(k):
                    return sum(any(d == i is not None and lab[k] == 1 for d, *lab in labels)
                               for i, _ in gone)

                out.add((part, "".join(order), step,
                         sum(not f & before and x not in f for _, f in mine), len(gone),
                         sum(x in f and bool(f & before) for _, f in mine),
                         sum(f == {x} for _, f in mine), lost(0), lost(1), shapley[x]))
    return out


def test_filter_audit_equals_brute_force(spark, docs, none):
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (7, 1, None), (None, 1, 1), (10, None, 1), (99, 1, 1)]
    table = spark.createDataFrame([(*x, "clash") for x in labels],
                                  "doc_id long, quality int, toxic int, part string")
    want = brute_audit(TEXTS, labels)
    for bound in (1_000_000, 0):
        got = filter_audit.audit(filter_audit.combinations(docs, table, copies_per_task=2,
                                                           max_broadcast=bound))
        assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want) == 600 * 3
    assert filter_audit.audit(filter_audit.combinations(none, table)).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit(
        filter_audit.combinations(docs, table.limit(0))).collect()} == {0}


def test_closest_multiset_equals_all_multisets():
    rnd = random.Random(3)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(0, 4) for _ in range(rnd.randint(1, 5))}
        room = rnd.randint(0, 60)
        chosen = packing.closest_multiset(counts, room)
        best = max(s for ks in product(*[range(c + 1) for c in counts.values()])
                   if (s := sum(n * k for n, k in zip(counts, ks))) <= room)
        assert sum(n * k for n, k in chosen.items()) == best
        assert all(0 < k <= counts[n] for n, k in chosen.items())


def test_plan_places_every_token_once():
    for seed in range(60):
        rnd = random.Random(seed)
        cap = rnd.choice([8, 16, 37, 64])
        counts = {rnd.randint(1, cap - 1): rnd.randint(1, 40) for _ in range(rnd.randint(1, 9))}
        plan = packing.Plan(counts, cap)
        filled = defaultdict(set)
        for n, c in counts.items():
            for rank in range(c):
                pieces = list(plan.locate(n, rank))
                assert sum(size for size, _, _ in pieces) == n
                for size, seq, off in pieces:
                    new = set(range(off, off + size))
                    assert not new & filled[seq]
                    filled[seq] |= new
        assert set(filled) == set(range(plan.sequences))
        for got in filled.values():
            assert got == set(range(len(got)))
            assert len(got) == cap or len(got) & (len(got) - 1) == 0
    big = packing.Plan({n: 10 ** 9 + n for n in range(1, 1024)})
    assert sum(map(len, big.places.values())) < 5000


@pytest.mark.parametrize("max_offsets", [packing.MAX_OFFSETS, 0])
def test_packing_keeps_every_id(docs, none, max_offsets):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(byte_bpe.default_file())
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (0,))
                   for i, t, _ in TEXTS)
    rows = packing.pack(docs, byte_bpe.default_file(), max_offsets=max_offsets).withColumn(
        "crc", F.crc32("ids")).collect()
    sequences, by_id = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u4")
        assert len(ids) == r["length"] and r["crc"] == zlib.crc32(r["ids"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_id[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0
    # pieces of rows that share id and length stand side by side: compare their ids as a multiset
    for (i, n), pieces in by_id.items():
        texts = [ids for (j, ids), c in want.items() if (j, len(ids)) == (i, n) for _ in range(c)]
        assert sum(len(p) for _, p in pieces) == n * len(texts)
        for start, ids in pieces:
            assert any(tuple(ids) == t[start:start + len(ids)] for t in texts)
    assert sum(r["length"] for r in rows) == sum(len(ids) * c for (_, ids), c in want.items())
    assert packing.pack(none, byte_bpe.default_file()).count() == 0


def test_byte_bpe_equals_library():
    from tokenizers import Tokenizer
    rnd = random.Random(1)
    chars = "ab  \n\t'sé日😀\x1c\x85​　 0123.,;!́ſK²Ⅷ"
    for plain in (False, True):
        tok = Tokenizer.from_file(byte_bpe.default_file())
        tok.encode_special_tokens = plain
        bpe = byte_bpe.byte_bpe(byte_bpe.default_file(), plain)
        assert bpe.fast is not None
        texts = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
        texts += ["a<|endoftext|>b <|endoftext|>", " " * 450_000, "q" * 20_000, "\n" * 5000 + "x"]
        for t in texts:
            assert bpe.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_gallop_equals_intersection():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(rnd.integers(0, rnd.integers(1, 400), rnd.integers(0, 200))) for _ in "ab")
        i, j = alignment.gallop(a, b, block=int(rnd.integers(1, 9)))
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(alignment.default_a())
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.default_b())
    alphabet = byte_bpe.byte_alphabet()
    docs = []
    for i, t in texts:
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids
        b = sp.encode(t or "")
        raw_a = [bytes(alphabet[c] for c in tok.id_to_token(x)) if tok.id_to_token(x) != "<|endoftext|>"
                 else b"<|endoftext|>" for x in a]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
                 for p in map(sp.id_to_piece, b)]
        want = (" " + (t or "")).encode()
        if not t or b"".join(raw_a) != want or b"".join(raw_b) != want:
            docs.append((i, [], [], [], Counter()))
            continue
        ends = []
        for raw in (raw_a, raw_b):
            at, e = 0, []
            for x in raw:
                at += len(x)
                e.append(at)
            ends.append(e)
        groups, la, lb = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            na, nb = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[la:na], b[lb:nb]))
            la, lb = na, nb
        links = Counter(pair for ga, gb in groups for pair in product(ga, gb))
        docs.append((i, a, b, groups, links))
    counts = Counter(pair for *_, links in docs for pair in links)
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for i, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, len(a), len(b), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if counts[p] == best[p[0]]),
                    sum(n * counts[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


@pytest.mark.parametrize("large", [alignment.LARGE_GROUP, 1])
def test_alignment_equals_brute_force(spark, docs, none, large, monkeypatch):
    # forked workers see the module as it is now
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    short = [(i, t) for i, t, _ in TEXTS if len(t or "") < 30_000]
    table = docs.filter(F.length(F.coalesce("text", F.lit(""))) < 30_000)
    aligned = alignment.align(table, alignment.default_a(), alignment.default_b()).checkpoint()
    want = sorted(brute_alignment(short), key=repr)
    for bound in (1_000_000, 0):
        got = alignment.score(aligned, bound).select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
            F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(w[1] == 0 for w in want) and any(w[4] > 1000 for w in want)
    assert alignment.score(alignment.align(none, alignment.default_a(), alignment.default_b())
                           .checkpoint()).count() == 0


def test_large_groups_count_like_small_ones():
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(0, 9, 500), rnd.integers(0, 9, 700)
    stops = [np.array([3, 200, 500]), np.array([1, 400, 700])]
    keys, counts = alignment.linked_pairs(a, b, *stops)
    want, la, lb = Counter(), 0, 0
    for na, nb in zip(*stops):
        want.update((int(x) << alignment.B_BITS) | int(y) for x, y in product(a[la:na], b[lb:nb]))
        la, lb = na, nb
    assert dict(zip(keys.tolist(), counts.tolist())) == want
    assert all(len(set(x)) == len(x) for x in combinations(keys.tolist(), 2))
