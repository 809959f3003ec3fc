"""Filter interaction audit (operator 11): what each of five filters removes in every order.

Four filters look at one text (A short, B repetitive, C capitals, D marks). The fifth, E, marks
a document whose text a smaller ``doc_id`` of the whole table also has: an existential self-join,
``left_semi`` on the text's hash, the exact text and a smaller ``doc_id``. Its ids are united with
the failures of the other filters, every document becomes one combination of five bits, and the
combinations are counted per part. All 120 orders follow from these at most 32 counts of a part.

The self-join moves texts only where a hash occurs more than once. Its witnesses are one row per
distinct text (the smallest id, aggregated before the shuffle); where a text has very many copies
the witness is repeated once per ``COPIES_PER_TASK`` copies and the copies are dealt out over
these, so a group of a third of all rows is spread over as many tasks as it needs.

Defined results: a null text is the empty text, a null part the empty string. A null ``doc_id``
is never smaller nor larger than another, so E never fails for it, and it has no labels. Rows
that repeat ``doc_id`` and text count as documents of their own; neither is smaller than the other.
A document is good (toxic) if any label row of its id says so. Extra columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marksmith.llm.common import (MAX_BROADCAST_IDS, checkpointed, read, sha256_hex, text_column)

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
MIN_WORDS = 200
#: Copies of one text that go to one task of the self-join.
COPIES_PER_TASK = 64
#: The white space that divides words, as a Java regular expression.
SPACE = "[\\x20\\x09-\\x0D]+"


def text_bits(text: Column) -> Column:
    """Bits of the filters that look at one text."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    tests = {"A": n < MIN_WORDS, "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
             "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}
    bits = F.lit(0)
    for name, test in tests.items():
        bits = bits + F.when(test, BIT[name]).otherwise(0)
    return bits


def facts_of(docs: DataFrame, part: str = "source") -> DataFrame:
    """``(doc_id, part, digest, bits)`` of every row: all that the texts are read for but E."""
    text = text_column()
    return docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"),
                       F.unhex(sha256_hex(text)).alias("digest"), text_bits(text).alias("bits"))


def later_copies(docs: DataFrame, facts: DataFrame, part: str = "source",
                 copies_per_task: int = COPIES_PER_TASK,
                 max_broadcast: int = MAX_BROADCAST_IDS) -> DataFrame:
    """``(doc_id, digest, part)`` of the rows whose text a smaller ``doc_id`` also has."""
    repeated = checkpointed(facts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
                            .filter("n > 1"))
    rows = repeated.count()
    tasks = F.ceil(F.col("n") / F.lit(copies_per_task)).cast("int").alias("tasks")
    hashes = repeated.select(F.col("digest").alias("h"), tasks)
    texts = docs.filter("doc_id is not null").select(
        "doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text_column().alias("t"))
    texts = texts.withColumn("digest", F.unhex(sha256_hex(F.col("t"))))
    texts = texts.join(F.broadcast(hashes) if rows <= max_broadcast else hashes.hint("merge"),
                       texts["digest"] == hashes["h"]).drop("h")
    first = texts.groupBy("digest", "t", "tasks").agg(F.min("doc_id").alias("first_id"))
    witness = first.select(F.col("digest").alias("h"), F.col("t").alias("same"), "first_id",
                           F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    copies = texts.withColumn("dealt", F.pmod(F.xxhash64("doc_id"), F.col("tasks")).cast("int"))
    found = copies.join(witness.hint("merge"),
                        (copies["digest"] == witness["h"]) & (copies["dealt"] == witness["task"])
                        & (copies["t"] == witness["same"])
                        & (witness["first_id"] < copies["doc_id"]), "left_semi")
    return found.select("doc_id", "digest", "part")


def combinations(docs: DataFrame, labels: DataFrame, part: str = "source",
                 copies_per_task: int = COPIES_PER_TASK,
                 max_broadcast: int = MAX_BROADCAST_IDS) -> DataFrame:
    """``(part, bits, n, good, toxic)``: documents of each part by the filters that they fail."""
    facts = checkpointed(facts_of(docs, part))
    again = later_copies(docs, facts, part, copies_per_task, max_broadcast)
    long = lambda n: F.lit(n).cast("long").alias("n")
    united = facts.withColumn("n", long(1)).unionByName(
        again.select("*", F.lit(BIT["E"]).alias("bits"), long(0)))
    # rows that agree in id, text and part are one group: all five bits are the same for them
    rows = united.groupBy("doc_id", "digest", "part").agg(F.bit_or("bits").alias("bits"),
                                                          F.sum("n").alias("n"))
    by_id = rows.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    known = (labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("l_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    judged = by_id.join(known, by_id["doc_id"] == known["l_id"], "left")
    return judged.groupBy("part", "bits").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def with_steps(parts: DataFrame) -> DataFrame:
    """Each row once per order and step, with ``bit`` of the step's filter and the bits of the
    filters ``before`` it."""
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])

    def bit(at: Column) -> Column:
        return F.element_at(F.lit([BIT[name] for name in FILTERS]),
                            F.instr(F.lit(FILTERS), F.substring("filter_order", at, F.lit(1))))

    steps = F.sequence(F.lit(1), F.lit(len(FILTERS)))
    rows = (parts.withColumn("filter_order", F.explode(orders))
            .withColumn("bits_in_order", F.transform(steps, bit)))
    return rows.select("*", F.posexplode("bits_in_order").alias("at", "bit")).select(
        *parts.columns, "filter_order", (F.col("at") + 1).alias("step"), "bit",
        F.aggregate(F.slice("bits_in_order", 1, F.col("at")), F.lit(0),
                    lambda acc, b: acc.bitwiseOR(b)).alias("before"))


def audit(combos: DataFrame) -> DataFrame:
    """Every order and step of every part, from its counted combinations."""
    orders = 1
    for k in range(2, len(FILTERS) + 1):
        orders *= k
    # at most 2 ** 5 combinations a part
    parts = combos.groupBy("part").agg(
        F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("combos"))
    rows = with_steps(parts)

    def total(value: str, test) -> Column:
        return F.aggregate("combos", F.lit(0).cast("long"), lambda acc, c: acc + F.when(
            test(c["bits"]), c[value]).otherwise(0))

    fails = lambda b: b.bitwiseAND(F.col("bit")) != 0
    gone = lambda b: b.bitwiseAND(F.col("before")) != 0
    removed = lambda b: fails(b) & ~gone(b)
    # of k failed filters each one comes first in 1 / k of the orders
    shapley = F.aggregate("combos", F.lit(0).cast("long"), lambda acc, c: acc + F.when(
        fails(c["bits"]), c["n"] * F.lit(orders) / F.bit_count(c["bits"])).otherwise(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda b: ~fails(b) & ~gone(b)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda b: fails(b) & gone(b)).alias("redundant"),
        total("n", lambda b: b == F.col("bit")).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        shapley.alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(combinations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM w GROUP BY t),
f AS (
  SELECT w.doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
         100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 2 * length(w.t) AS c,
         regexp_matches(w.t, '[#$%&*|]') AS d, coalesce(first_id < w.doc_id, false) AS e
  FROM w JOIN firsts USING (t)),
l AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic
      FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good,
         sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::int AS step FROM orders),
bits AS (
  SELECT *, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS failed
  FROM docs),
judged AS (
  SELECT part, filter_order, step, n, good, toxic, failed,
         substr(filter_order, step, 1) AS here,
         list_contains(failed, substr(filter_order, step, 1)) AS fails,
         len(list_filter(failed, lambda x: position(x IN substr(filter_order, 1, step - 1)) > 0)) > 0
           AS gone
  FROM bits, steps),
counted AS (
  SELECT part, filter_order, step,
         sum(n) FILTER (NOT fails AND NOT gone) AS kept,
         sum(n) FILTER (fails AND NOT gone) AS removed,
         sum(n) FILTER (fails AND gone) AS redundant,
         sum(n) FILTER (fails AND len(failed) = 1) AS unique_fails,
         sum(good) FILTER (fails AND NOT gone) AS good_lost,
         sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost
  FROM judged GROUP BY ALL),
shares AS (
  SELECT part, substr(filter_order, step, 1) AS here, sum(removed) AS shapley
  FROM counted GROUP BY ALL)
SELECT c.part, c.filter_order, c.step, coalesce(kept, 0)::bigint AS kept,
       coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant,
       coalesce(unique_fails, 0)::bigint AS unique_fails,
       coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost,
       coalesce(shapley, 0)::bigint AS shapley
FROM counted c JOIN shares s ON c.part = s.part AND substr(c.filter_order, c.step, 1) = s.here
"""
