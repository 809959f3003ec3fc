"""URL filter with stated rules and mined association rules (operator 3).

Stated rules (host suffix and path prefix) come first. Every other URL is judged by rules mined
with FP-growth: transactions are the token sets of labelled URLs plus the label as one more item;
frequent item sets that hold a label give rules ``tokens -> label``. Tokens that stand in exactly
the same labelled URLs are one item, since k of them would make 2 ** k sets of equal support; a
URL has the item if it has any of them, which is what the rules of the single tokens would say.
Rules are pruned by support,
confidence and lift, and where a rule with fewer tokens is as confident. An inverted index lists
each rule under its rarest token; a URL matches a rule when it has all of the rule's tokens, and
its most confident rule decides. Without a matching rule a URL gets the default verdict.

Labels: a labelled page is to be blocked when it is toxic or of low quality.

Defined results: a null URL or one without ``://`` has an empty host and path, no tokens, no
stated rule and the default verdict. Without labelled pages nothing is mined. Null labels are
ignored, repeated labels of a page count as block if any is. Rows are judged one by one; ties
between rules go to more support, then more tokens, then block, then the tokens in order. Extra
columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marksmith.llm.common import checkpointed, read

BLOCK, ALLOW = "block", "allow"
DEFAULT_VERDICT = ALLOW
#: The stated rules: host, path, verdict.
STATED_RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW),
                ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))
MIN_SUPPORT = 0.005
#: A rule holds for at least so many labelled pages, however few there are.
MIN_COUNT = 5
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.2
#: Rule tables up to this many rows are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_RULES = 100_000
RULE_SCHEMA = ("tokens array<string>, verdict string, confidence double, support long, "
               "members array<array<string>>")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules=STATED_RULES) -> Column:
    """The longest stated rule that fits, as ``struct(rule, verdict)``; null where none does."""
    out = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
                     ).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path words without numbers, file ending, query keys
    and fragment."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, r"://[^/?#]*[^?#]*(.*)$", 1)

    def tagged(tag: str, parts: Column) -> Column:
        good = F.filter(parts, lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
        return F.transform(good, lambda x: F.concat(F.lit(tag), x))

    path = path_of(url)
    words = F.split(F.lower(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")), "[/_.-]+")
    ending = F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(rest, r"^\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.element_at(F.split(x, "="), 1))
    scheme = F.regexp_extract(u, r"^([A-Za-z]+)://", 1)
    every = F.concat(tagged("s:", F.array(F.lower(scheme))),
                     tagged("h:", F.split(host_of(url), r"\.")), tagged("p:", words),
                     tagged("e:", F.array(F.lower(ending))), tagged("q:", keys),
                     tagged("f:", F.array(F.regexp_extract(rest, "#(.*)$", 1))))
    return F.array_distinct(F.when(u.contains("://"), every).otherwise(F.array().cast("array<string>")))


def page_labels(labels: DataFrame) -> DataFrame:
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return (labels.filter(bad.isNotNull() & F.col("doc_id").isNotNull())
            .groupBy(F.col("doc_id").alias("_label_id")).agg(F.max(bad).alias("_bad")))


def merged_items(baskets: DataFrame, least: int) -> DataFrame:
    """``token, item, members``: frequent tokens of ``(id, tokens)``, those of the same rows under
    one item (the first of them). Rows are compared by their number and 128 bits of their ids."""
    seen = baskets.select("id", F.explode("tokens").alias("token"))
    same = (seen.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.lit(1), F.col("id"))).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(2), F.col("id"))).alias("y")).filter(F.col("n") >= least))
    # all members of an item stand in one URL, so they are few
    items = same.groupBy("n", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return items.select(F.explode("members").alias("token"),
                        F.element_at("members", 1).alias("item"), "members")


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT,
               min_count: int = MIN_COUNT) -> DataFrame:
    """Pruned association rules ``tokens, verdict, confidence, support, members``: ``tokens`` are
    items, and ``members`` the tokens that each item stands for."""
    spark = pages.sparkSession
    mark = F.when(F.col("_bad"), F.lit("=" + BLOCK)).otherwise(F.lit("=" + ALLOW))
    rows = pages.select("page_id", "url").join(
        page_labels(labels), F.col("page_id") == F.col("_label_id"))
    tokens = checkpointed(rows.select(F.monotonically_increasing_id().alias("id"),
                                      tokens_of(F.col("url")).alias("tokens"), mark.alias("mark")))
    total = tokens.count()
    if total < min_count or not total:
        return spark.createDataFrame([], RULE_SCHEMA)
    support = max(min_support, min_count / total)
    # frequent tokens: at most the tokens of a URL / support
    items = checkpointed(merged_items(tokens, ceil(support * total)))
    named = (tokens.select("id", F.explode("tokens").alias("token"))
             .join(F.broadcast(items.select("token", "item")), "token")
             .groupBy("id").agg(F.collect_set("item").alias("found")))
    baskets = checkpointed(tokens.select("id", "mark").join(named, "id", "left").select(F.concat(
        F.coalesce("found", F.array().cast("array<string>")), F.array("mark")).alias("items")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=support, numPartitions=parts).fit(baskets)
    sets = checkpointed(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    out = None
    for verdict in (BLOCK, ALLOW):
        label = F.lit("=" + verdict)
        share = sets.filter((F.size("items") == 1) & F.array_contains("items", label)).first()
        least = max(min_confidence, min_lift * share["freq"] / total) if share else 2.0
        both = sets.filter(F.array_contains("items", label) & (F.size("items") > 1)).select(
            F.array_remove("items", label).alias("tokens"), F.col("freq").alias("support"))
        rules = both.join(sets.select(F.col("items").alias("tokens"), "freq"), "tokens").withColumn(
            "confidence", F.col("support") / F.col("freq"))
        rules = rules.filter(F.col("confidence") >= least).select(
            "tokens", F.lit(verdict).alias("verdict"), "confidence", "support")
        out = rules if out is None else out.unionByName(rules)
    rules = checkpointed(prune(checkpointed(out)))
    members = (rules.select("verdict", "tokens", F.posexplode("tokens").alias("at", "item"))
               .join(items.filter("token = item").select("item", "members"), "item")
               .groupBy("verdict", "tokens").agg(F.array_sort(F.collect_list(
                   F.struct("at", "members"))).alias("m")))
    return rules.join(members, ["verdict", "tokens"]).select(
        "tokens", "verdict", "confidence", "support",
        F.transform("m", lambda x: x["members"]).alias("members"))


def inverted_index(rules: DataFrame) -> DataFrame:
    """Each rule under its rarest token, rarity being the support of the rules that hold it."""
    named = rules.withColumn("rule_id", F.concat_ws(" ", F.col("verdict"), F.col("tokens")))
    weight = (named.select(F.explode("tokens").alias("token"), "support")
              .groupBy("token").agg(F.sum("support").alias("w")))
    listed = named.select("*", F.explode("tokens").alias("token")).join(weight, "token")
    rarest = listed.groupBy("rule_id").agg(F.min(F.struct("w", "token"))["token"].alias("token"))
    return rarest.join(named, "rule_id")


def prune(rules: DataFrame) -> DataFrame:
    """Drop rules for which one with some of their tokens and the same verdict is as confident."""
    named = rules.withColumn("_id", F.concat_ws(" ", F.col("verdict"), F.col("tokens")))
    general = inverted_index(rules).select(
        "token", F.col("tokens").alias("g"), F.col("verdict").alias("gv"),
        F.col("confidence").alias("gc"))
    special = named.select("_id", "tokens", "verdict", "confidence",
                           F.explode("tokens").alias("token"))
    beaten = (special.join(general, "token")
              .filter((F.col("gv") == F.col("verdict")) & (F.size("g") < F.size("tokens"))
                      & (F.col("gc") >= F.col("confidence"))
                      & (F.size(F.array_except("g", "tokens")) == 0))
              .select("_id").distinct())
    return named.join(beaten, "_id", "left_anti").drop("_id")


def judge_urls(pages: DataFrame, rules: DataFrame, stated=STATED_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_verdict, confidence`` for every row."""
    index = inverted_index(rules).withColumn("at", F.array_position("tokens", F.col("token")))
    # listed under each member of its rarest item
    index = checkpointed(index.select(
        F.explode(F.element_at("members", F.col("at").cast("int"))).alias("token"),
        F.col("tokens").alias("needs"), "members", F.col("verdict").alias("v"), "confidence",
        "support"))
    index = F.broadcast(index) if index.count() <= MAX_BROADCAST_RULES else index
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                        tokens_of(url).alias("tokens")).withColumn(
        "_row", F.monotonically_increasing_id())
    hits = rows.withColumn("token", F.explode_outer("tokens")).join(index, "token", "left")
    fits = F.forall("members", lambda any_of: F.arrays_overlap(any_of, F.col("tokens")))
    rank = F.struct("confidence", "support", F.size("needs").alias("size"),
                    (F.col("v") == BLOCK).alias("block"), "needs", "v")
    # the rows of one URL lie together, so they are one before the shuffle
    best = hits.groupBy("_row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"),
        F.first("path").alias("path"), F.max(F.when(fits, rank)).alias("best"))
    judged = best.withColumn("stated", stated_rule(F.col("host"), F.col("path"), stated))
    mined = F.coalesce(F.col("best.v"), F.lit(DEFAULT_VERDICT))
    return judged.select("page_id", "host", "path", F.col("stated.rule").alias("rule"),
                         F.coalesce(F.col("stated.verdict"), mined).alias("verdict"),
                         mined.alias("mined_verdict"), F.col("best.confidence").alias("confidence"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge_urls(pages, mine_rules(pages, read(spark, sf_dir, "labels")))


ORACLE_SQL = None
