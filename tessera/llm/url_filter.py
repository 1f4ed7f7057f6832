"""URL filters: fixed host rules first, then association rules mined from labels.

Tokens of a URL are the labels of its host, the words of its path and the keys of its query. Labelled
URLs, with the token of their label, are transactions of Spark's FP-growth. Rules whose consequent is the
blocking label are kept if they reach the least support, if blocking is likelier than not where they hold
(confidence), if that is well over the label's share of all URLs (lift), and if chance could hardly have
made the difference (evidence: the log-likelihood ratio against that share); those that a shorter kept rule
implies are dropped. A rule is indexed under the rarest of its tokens alone; a URL meets it by
that token and is blocked if it holds all the others too.

Tokens in exactly the same labelled URLs are mined as one, so URLs that share a long unchanging part do
not multiply itemsets. Each of these twins alone would give the same rule, so they are alternatives: such a
rule asks for any one of each group of twins, is indexed under all of its rarest group, and counts once.

Defined results: a null URL, or one without ://, has empty host and path, meets no fixed rule and is
judged by its tokens, if any; repeated labels of a page block if any does; repeated rows are judged
alike; ties between fixed rules cannot occur, as equal rules would be the same; without labels, or
without rules, the verdict is the fixed rule's or allow; an empty table gives an empty result; other
columns are not looked at. URLs are taken whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.support import lower_az, materialize


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("example.com", "/de/", "block"), HostRule("org", "/fr/", "allow"))


@dataclass(frozen=True)
class Settings:
    #: Share of the labelled URLs, and their least number, that a rule's tokens and label share.
    support: float = 0.005
    least: int = 10
    confidence: float = 0.5
    lift: float = 1.5
    #: Twice the log-likelihood ratio of a rule's URLs against the share of the blocking label: 15 is about one in 10,000 by chance.
    evidence: float = 15.0
    #: Most rules that are broadcast; more are joined by a shuffle.
    broadcast: int = 20_000


BLOCK = "label:block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.substring_index(url, "://", 1)
    rest = F.when(F.instr(url, "://") > 0, F.right(url, F.length(url) - F.length(rest) - 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_az(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: h:label, p:word and q:key."""
    some = lambda parts, mark: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "\\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.array_distinct(F.concat(some(F.split(host, "[.:@]"), "h:"), some(F.split(F.lower(path), "[^\\p{L}\\p{N}]+"), "p:"), some(keys, "q:")))


def fixed_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest fixed rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def mine(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rules (rule_id, items, groups, confidence, support) from labelled URLs (id, tokens, block). groups: items by twins, of which one each is enough."""
    s, spark = settings, labelled.sparkSession
    none = spark.createDataFrame([], "rule_id long, items array<string>, groups array<array<string>>, confidence double, support double")
    n = labelled.count()
    least = max(s.least, math.ceil(s.support * n))
    if n < least:
        return none
    each = labelled.select("id", F.explode("tokens").alias("token"))
    # the same URLs: equal counts and equal sums of two hashes of their ids
    mark = lambda k: F.sum(F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1 << 40)))
    frequent = each.groupBy("token").agg(F.count("*").alias("n"), mark(1).alias("a"), mark(2).alias("b")).filter(F.col("n") >= least)
    twins = materialize(frequent.groupBy("n", "a", "b").agg(F.min("token").alias("token"), F.array_sort(F.collect_set("token")).alias("all")))
    baskets = each.join(twins.select("token"), "token").groupBy("id").agg(F.collect_set("token").alias("items"))
    marked = labelled.select("id", "block").join(baskets, "id").select(F.when(F.col("block"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=s.confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(materialize(marked))
    share, held = F.col("confidence") / F.col("lift"), F.round(F.col("support") * n / F.col("confidence"))
    part = lambda got, expected: F.when((got > 0) & (expected > 0), got * F.log(got / expected)).otherwise(0.0)
    hits = F.round(F.col("support") * n)
    evidence = 2 * (part(hits, held * share) + part(held - hits, held * (1 - share)))
    strong = (F.col("confidence") >= s.confidence) & (F.col("lift") >= s.lift) & (evidence >= s.evidence)
    found = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK) & strong).select("antecedent", "confidence", "support")
    found = materialize(found.withColumn("rule_id", F.xxhash64(F.array_sort("antecedent"))))
    # a rule that a shorter one implies adds nothing: the shorter one shares its least token with it
    least_of = found.select(F.col("rule_id").alias("short"), F.col("antecedent").alias("inner"), F.array_min("antecedent").alias("token"))
    implied = found.select("rule_id", "antecedent", F.explode("antecedent").alias("token")).join(least_of, "token").filter((F.size("inner") < F.size("antecedent")) & (F.size(F.array_except("inner", "antecedent")) == 0)).select("rule_id").distinct()
    found = found.join(implied, "rule_id", "left_anti")
    spread = found.select("rule_id", "confidence", "support", F.explode("antecedent").alias("token")).join(twins.select("token", "all"), "token")
    return spread.groupBy("rule_id").agg(F.array_sort(F.flatten(F.collect_list("all"))).alias("items"), F.array_sort(F.collect_list("all")).alias("groups"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))


def filter_urls(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", rules: tuple[HostRule, ...] = RULES, settings: Settings = Settings()) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, verdict, matched (mined rules met), confidence (their highest), mined_rules (how many there are)."""
    c = lambda n: F.col(f"`{n}`")
    host, path = host_and_path(c(url))
    read = pages.select(c(page_id).cast("long").alias("page_id"), c(url).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    urls = read.select("url", "host", "path").distinct().withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    urls = materialize(urls)
    marks = labels.groupBy(c(label_id).cast("long").alias("page_id")).agg(F.max(((c("toxic") == 1) | (c("quality") == 0)).cast("int")).alias("block")).filter("block IS NOT NULL")
    labelled = read.filter("page_id IS NOT NULL").join(marks, "page_id").withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    labelled = labelled.groupBy("page_id", "url").agg(F.first("tokens").alias("tokens"), F.max("block").alias("block"))
    labelled = materialize(labelled.select(F.xxhash64("page_id", "url").alias("id"), "tokens", (F.col("block") == 1).alias("block")))
    mined = materialize(mine(labelled, settings))
    n_rules = mined.count()
    if n_rules:
        # the rarest token, or group of twins, of each rule, over all URLs
        use = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        each = mined.select("rule_id", F.explode("groups").alias("group")).select("rule_id", "group", F.explode("group").alias("token"))
        held = each.join(use, "token", "left").groupBy("rule_id", "group").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
        rarest = held.groupBy("rule_id").agg(F.min(F.struct("n", "group"))["group"].alias("group"))
        index = materialize(rarest.join(mined, "rule_id").select(F.explode("group").alias("token"), "group", "rule_id", "groups", "confidence"))
        index = F.broadcast(index) if index.count() <= settings.broadcast else index
        met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
        # once for each rule, by the first of the twins that the URL holds
        met = met.filter((F.array_intersect("tokens", "group")[0] == F.col("token")) & F.forall("groups", lambda g: F.arrays_overlap(g, F.col("tokens"))))
        met = met.groupBy("url").agg(F.count("*").alias("matched"), F.max("confidence").alias("confidence"))
    else:
        met = urls.limit(0).select("url", F.lit(0).cast("long").alias("matched"), F.lit(None).cast("double").alias("confidence"))
    by = met.withColumnRenamed("url", "met_url")
    out = read.join(by, F.col("url").eqNullSafe(F.col("met_url")), "left")
    matched = F.coalesce("matched", F.lit(0)).cast("long")
    return out.select("page_id", "url", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(matched > 0, "block").otherwise("allow")).alias("verdict"), matched.alias("matched"), "confidence", F.lit(n_rules).cast("long").alias("mined_rules"))
