"""Personal data by weak supervision (operator 5).

1. Base spans (email, ip, card, phone) follow fixed patterns and always stand.
2. Wider candidates (written-out addresses, IPv6, national phone numbers, grouped digit runs) and
   the base spans are voted on by labelers: the strict pattern, a structure check, a gazetteer
   and the words around. A vote is for (1), against (-1) or none (0).
3. Expectation-maximisation over the counts of vote patterns estimates, per kind, how reliable
   each labeler is, and so how probable it is that a candidate is personal.
4. These probabilities train the span classifier, a logistic regression over the span's form and
   surroundings; candidates that it accepts and that touch no base span are added.

The counts of (kind, votes, features) cover all documents and are aggregated before the shuffle;
all features have few values, so the table that reaches the driver has a fixed bound.

Defined results: a null text is the empty text and has no spans. Positions are code points, ends
exclusive. Rows are judged one by one, so ties, repeated rows and extra columns have no
influence; where nothing can be learned only base spans are returned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksmith.llm.common import map_batches, read, sha256_hex, short_batches, text_column

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "structure", "gazetteer", "context")
EM_ROUNDS = 60
ACCEPT = 0.5

# fixed values: the base patterns
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is entered at its first digit and never given back: same matches, linear time
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# wider candidates
SPELT_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}"
                         r"(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}")
IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![\w:])")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}"
                         r"[ .-][0-9]{3,4}(?![\w])")
DIGIT_GROUPS = re.compile(r"(?<![\w.+-])[0-9]{3,6}(?:[ .-]?[0-9]{3,6}){2,5}(?![\w])")

# gazetteers
TOP_LEVEL = frozenset("com org net edu gov int mil info biz io de fr es uk it nl eu us ca au ch at "
                      "be se no dk fi pl pt br jp cn in ru mx".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "36", "30", "22",
           "23", "24", "25", "26", "27")
DIAL_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44",
              "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62",
              "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "353", "358")
CUES = {"email": "mail e-mail email contact write correo courriel schreiben".split(),
        "ip": "ip address host server login adresse client".split(),
        "card": "card visa mastercard credit debit karte carte tarjeta payment amex".split(),
        "phone": "tel phone call fax mobile cell telefon telefono anruf appel whatsapp".split()}
COUNTER_CUES = frozenset("version v token key isbn issn invoice order ref id page pages price eur "
                         "usd section figure table chapter year sha hash commit serial".split())
WORDS_BEFORE = re.compile(r"[a-z-]+")

FEATURES = ("digits", "groups", "before", "after", "cue")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(number: str) -> bool:
    plain = number.lstrip("0")
    return len(plain) <= 3 and int(plain or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not re.search("[0-9]", text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text)
                if all(_small(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text)
                if 8 <= len(_digits(m.group())) <= 15]
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Wider candidates in order of kind and start that touch no base span and no other."""
    found = []
    if "(at)" in text or "[at]" in text or (" at " in text and (" dot " in text or "[dot]" in text)):
        found += [("email", *m.span()) for m in SPELT_EMAIL.finditer(text)]
    if text.count(":") >= 3:
        found += [("ip", *m.span()) for m in IPV6.finditer(text)]
    if re.search("[0-9]{3}", text):
        found += [("card", *m.span()) for m in DIGIT_GROUPS.finditer(text)
                  if 13 <= len(_digits(m.group())) <= 19]
        found += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)
                  if 7 <= len(_digits(m.group())) <= 15]
    # spans taken so far, merged where they overlap, so both lists are sorted
    starts, ends = [], []
    for s, e in sorted((s, e) for _, s, e in base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for kind, s, e in found:
        at = bisect_left(starts, e)  # the last span that starts before this one ends
        if not at or ends[at - 1] <= s:
            starts.insert(at, s)
            ends.insert(at, e)
            out.append((kind, s, e))
    return out


def votes_and_features(text: str, kind: str, start: int, end: int, is_base: bool):
    """The labelers' votes and the span's features, all of few values."""
    span, digits = text[start:end], _digits(text[start:end])
    around = text[max(0, start - 40):start].lower()
    words = WORDS_BEFORE.findall(around)[-4:]
    cue = 1 if any(w in CUES[kind] for w in words) else -1 if any(
        w in COUNTER_CUES for w in words) else 0
    if kind == "email":
        tail = re.split(r"[^A-Za-z0-9]+", span)[-1].lower()
        structure = 1 if len(span) <= 254 and ".." not in span else -1
        gazetteer = 1 if tail in TOP_LEVEL else -1
    elif kind == "ip":
        parts = span.split(".")
        structure = 1 if ":" in span or all(p == "0" or p[0] != "0" for p in parts) else -1
        gazetteer = 0 if ":" in span else -1 if parts[0] in ("0", "127", "255") else 1
    elif kind == "card":
        structure = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    else:
        structure = 1 if 10 <= len(digits) <= 13 else -1
        plain = digits[2:] if digits.startswith("00") else digits
        gazetteer = (1 if plain.startswith(DIAL_CODES) else -1) if span[0] == "+" or \
            digits.startswith("00") else 0
    votes = (1 if is_base else -1, structure, gazetteer, cue)

    def side(c: str) -> int:
        return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3

    features = (min(len(digits), 20), min(len(re.findall("[0-9]+", span)), 6),
                side(text[start - 1:start]), side(text[end:end + 1]), cue)
    return votes, features


def vote_counts(docs: DataFrame) -> DataFrame:
    """``(kind, v0.., f0.., n)``: how often each pattern of votes and features occurs."""
    names = [f"v{i}" for i in range(len(LABELERS))] + [f"f{i}" for i in range(len(FEATURES))]
    schema = "kind string, " + ", ".join(f"{c} int" for c in names) + ", n long"

    def run(batch: pa.RecordBatch) -> dict:
        seen: dict[tuple, int] = defaultdict(int)
        for t in batch.column("_t").to_pylist():
            base = base_spans(t)
            for group, is_base in ((base, True), (candidates(t, base), False)):
                for kind, s, e in group:
                    votes, features = votes_and_features(t, kind, s, e, is_base)
                    seen[kind, *votes, *features] += 1
        columns = list(zip(*seen, strict=True)) if seen else [()] * (1 + len(names))
        return dict(zip(["kind", *names], columns, strict=True)) | {"n": list(seen.values())}

    return map_batches(docs, run, schema).groupBy("kind", *names).agg(F.sum("n").alias("n"))


def reliabilities(votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: per vote pattern the probability of being personal, and per
    labeler ``P(vote | personal?)`` as an array labelers x 2 x 3. Starts from the majority."""
    p = np.clip(0.5 + 0.4 * np.sign(votes[:, :].sum(axis=1)), 0.05, 0.95)
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(EM_ROUNDS):
        weight = np.stack([n * (1 - p), n * p])
        prior = weight.sum(axis=1) + 1.0
        for k in range(votes.shape[1]):
            for v in (-1, 0, 1):
                table[k, :, v + 1] = weight[:, votes[:, k] == v].sum(axis=1) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        score = np.log(prior / prior.sum())[:, None] + sum(
            np.log(table[k][:, votes[:, k] + 1]) for k in range(votes.shape[1]))
        p = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
    return p, table


def _columns(features: tuple[int, ...]) -> list[tuple[int, int]]:
    return list(enumerate(features))


class SpanClassifier:
    """Logistic regression over one-hot features, one model per kind."""

    def __init__(self):
        self.weights: dict[str, dict[tuple[int, int], float]] = {}
        self.reliability: dict[str, np.ndarray] = {}

    def fit(self, kind: str, features: list[tuple[int, ...]], p: np.ndarray, n: np.ndarray) -> None:
        names = sorted({c for f in features for c in _columns(f)})
        at = {c: i + 1 for i, c in enumerate(names)}
        x = np.zeros((len(features), len(names) + 1))
        x[:, 0] = 1
        for i, f in enumerate(features):
            x[i, [at[c] for c in _columns(f)]] = 1
        w, share = np.zeros(x.shape[1]), n / n.sum()
        for _ in range(400):
            q = 1 / (1 + np.exp(-x @ w))
            w -= 2.0 * (x.T @ (share * (q - p)) + 1e-4 * w)
        self.weights[kind] = {(-1, 0): float(w[0])} | {c: float(w[at[c]]) for c in names}

    def score(self, kind: str, features: tuple[int, ...]) -> float:
        w = self.weights.get(kind)
        if w is None:
            return 0.0
        z = w[-1, 0] + sum(w.get(c, 0.0) for c in _columns(features))
        return 1 / (1 + float(np.exp(-z)))


def learn(docs: DataFrame) -> SpanClassifier:
    """Estimate the labelers and train the classifier from all documents."""
    table = vote_counts(docs.select(text_column().alias("_t"))).toArrow().to_pylist()
    model = SpanClassifier()
    for kind in KINDS:
        rows = sorted((tuple(r[f"v{i}"] for i in range(len(LABELERS))),
                       tuple(r[f"f{i}"] for i in range(len(FEATURES))), r["n"])
                      for r in table if r["kind"] == kind)
        if not rows:
            continue
        n = np.array([r[2] for r in rows], dtype=float)
        p, model.reliability[kind] = reliabilities(np.array([r[0] for r in rows]), n)
        model.fit(kind, [r[1] for r in rows], p, n)
    return model


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find_spans(docs: DataFrame, model: SpanClassifier) -> DataFrame:
    """``doc_id, spans`` for every row, by kind as listed, then start."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(f"spans {SPANS}").fields])

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for t in batch.column("_t").to_pylist():
            base = base_spans(t)
            rows = [(KINDS.index(k), s, e, True) for k, s, e in base]
            for kind, s, e in candidates(t, base):
                _, features = votes_and_features(t, kind, s, e, False)
                if shared.value.score(kind, features) > ACCEPT:
                    rows.append((KINDS.index(kind), s, e, False))
            rows.sort()
            out.append([{"kind": KINDS[k], "start": s, "end": e, "base": b}
                        for k, s, e, b in rows])
        return {"doc_id": batch.column("doc_id"), "spans": out}

    return map_batches(docs.select("doc_id", text_column().alias("_t")), run, schema)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = find_spans(docs, learn(docs))
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS],
                        sha256_hex(joined(base)).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


ORACLE_SQL = None
