"""URL filters: host and path rules, and association rules mined by FP-growth.

A url is a set of tokens (scheme, host labels, path segments without numbers, extension, query
keys, fragment). FP-growth over the labelled urls finds token combinations that occur with the bad
label; those on enough urls (a count, not only a share) and with enough confidence are rules.
Only minimal rules are kept, as a url with all tokens of a larger one has those of the smaller one
too. So a token that is a rule alone needs no combinations, and is not given to FP-growth; nor is
one that too few bad urls have, or that every url has. Tokens that the labelled urls have always
together are one item, whichever of them a rule takes: no token is cut, and a long url has no more
combinations than it has tokens that can be told apart.

A rule stands in an inverted index under its rarest item, so a url meets only the rules of its own
items, and the whole combination is compared then. Only DataFrame functions and Spark ML are used.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised

#: The item that marks a bad url among its tokens; no token has this form.
BAD = "label=bad"
#: Bytes of rules that are sent to every task; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; "" without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; "" without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path prefix) that fits, else nulls."""
    fits, says = [], []
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        fits.append(F.when(fit, F.lit(rule_host + rule_path)))
        says.append(F.when(fit, F.lit(verdict)))
    none = F.lit(None).cast("string")
    return F.coalesce(*fits, none), F.coalesce(*says, none)


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a url (none for a url without ://)."""
    text = F.coalesce(url, F.lit(""))

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))

    path = path_of(url)
    segments = F.filter(F.split(path, "/"), lambda x: ~x.rlike(r"^[0-9]+(\.[a-z]+)?$"))
    extension = F.array(F.regexp_extract(path, r"\.([A-Za-z]{1,5})/?$", 1))
    query = F.split(F.regexp_extract(text, r"\?([^#]*)", 1), "&")
    keys = F.transform(query, lambda x: F.substring_index(x, "=", 1))
    fragment = F.array(F.regexp_extract(text, r"#(.*)$", 1))
    tokens = F.concat(
        tagged("scheme:", F.array(F.regexp_extract(text, r"(?s)^(.*?)://", 1))), tagged("host:", F.split(host_of(url), r"\.")),
        tagged("path:", segments), tagged("ext:", extension), tagged("query:", keys), tagged("frag:", fragment),
    )
    return F.when(text.contains("://"), F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def alike(tokens: DataFrame) -> DataFrame:
    """(token, item): of tokens (row, token) that are on the same rows, all have the smallest as item.

    Sets of rows are compared by their size and two 64-bit sums of hashes of the rows, which are summed
    before the shuffle, so a token of all rows is no single task's work.
    """
    sums = [F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]
    seen = tokens.groupBy("token").agg(F.count("*").alias("rows"), *sums)
    first = seen.groupBy("rows", "s1", "s2").agg(F.min("token").alias("item"))
    return seen.join(first, ["rows", "s1", "s2"]).select("token", "item")


def mine_items(
    labelled: DataFrame, min_count: int = 10, min_support: float = 0.0, min_confidence: float = 0.6
) -> tuple[DataFrame, DataFrame]:
    """((tokens, confidence, n), (token, item)): the minimal combinations of items that go with the bad
    label, on n bad urls, and the item of every token that can be in one.

    labelled has url and bad (boolean). Rows with a null in either are left out; rows that repeat
    count each. n is at least min_count and min_support times the rows.
    """
    known = labelled.where("url is not null and bad is not null").select(F.col("bad"), url_tokens(F.col("url")).alias("have"))
    known = materialised(known.withColumn("row", F.monotonically_increasing_id()))
    total = known.count()
    least = max(1, min_count, math.ceil(min_support * total))
    tokens = known.select("row", "bad", F.explode("have").alias("token"))
    counts = tokens.groupBy("token").agg(F.count_if("bad").alias("n"), F.count("*").alias("all"))
    counts = materialised(counts.where(F.col("n") >= least).withColumn("confidence", F.col("n") / F.col("all")))
    rule = F.col("confidence") >= min_confidence
    alone = counts.where(rule).select(F.array("token").alias("tokens"), "confidence", "n")
    told = tokens.join(counts.where(~rule & (F.col("all") < total)).select("token"), "token")
    members = materialised(alike(told.select("row", "token")))
    single = counts.where(rule).select("token", F.col("token").alias("item"))
    items = told.join(members.where("token = item").select("token"), "token")
    packed = items.groupBy("row", "bad").agg(F.collect_list("token").alias("t"))
    baskets = materialised(packed.select(F.when(F.col("bad"), F.array_append("t", F.lit(BAD))).otherwise(F.col("t")).alias("items")))
    if baskets.isEmpty():
        return alone, single
    rows = baskets.count()
    # FP-growth takes a share of its rows: that of half an url less than the count
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / rows), minConfidence=min_confidence).fit(baskets)
    joint = model.associationRules.where(F.col("consequent")[0] == BAD).select(
        F.col("antecedent").alias("tokens"), "confidence", F.round(F.col("support") * rows).cast("long").alias("n")
    )
    minimal = minimal_rules(materialised(joint.where(F.size("tokens") > 1)))
    return alone.unionByName(minimal), single.unionByName(members)


def mine_rules(labelled: DataFrame, min_count: int = 10, min_support: float = 0.0, min_confidence: float = 0.6) -> DataFrame:
    """(tokens, confidence, n): the minimal combinations of tokens that go with the bad label, on n bad
    urls: those of mine_items with every choice of a token for each item."""
    rules, members = mine_items(labelled, min_count, min_support, min_confidence)
    named = rules.withColumn("rule", F.monotonically_increasing_id()).select("rule", "confidence", "n", F.explode("tokens").alias("item"))
    options = named.join(members, "item").groupBy("rule", "confidence", "n", "item").agg(F.collect_list("token").alias("o"))
    lists = options.groupBy("rule", "confidence", "n").agg(F.collect_list("o").alias("l"))
    chosen = F.aggregate(
        "l", F.array(F.array().cast("array<string>")),
        lambda acc, o: F.flatten(F.transform(acc, lambda a: F.transform(o, lambda t: F.array_append(a, t)))),
    )
    return lists.select(F.explode(chosen).alias("tokens"), "confidence", "n")


def indexed(rules: DataFrame) -> DataFrame:
    """(token, need, confidence): every rule under its rarest token."""
    numbered = materialised(rules.withColumn("rule", F.xxhash64(F.array_sort("tokens"))))
    postings = numbered.select("rule", F.explode("tokens").alias("token"))
    rarity = postings.groupBy("token").agg(F.count("*").alias("n"))
    key = postings.join(rarity, "token").groupBy("rule").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    index = numbered.join(key, "rule").select("token", F.col("tokens").alias("need"), "confidence")
    size = numbered.agg(F.sum(F.octet_length(F.array_join("tokens", " ")) + 64)).first()[0] or 0
    return F.broadcast(index) if size <= BROADCAST_BYTES else index


def minimal_rules(rules: DataFrame) -> DataFrame:
    """The rules (tokens, ...) of which no proper part is a rule."""
    parts = rules.withColumn("token", F.explode("tokens")).join(indexed(rules), "token")
    larger = parts.where((F.size("need") < F.size("tokens")) & (F.size(F.array_except("need", "tokens")) == 0))
    return rules.join(larger.select("tokens").distinct(), "tokens", "left_anti")


def blocked_urls(urls: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """(url, confidence): the distinct urls that hold all items of a rule, with the best confidence; a url
    holds an item if it has one of its tokens (members)."""
    used = members.join(rules.select(F.explode("tokens").alias("item")).distinct(), "item")
    size = used.agg(F.sum(F.octet_length("token") + F.octet_length("item") + 32)).first()[0] or 0
    tokens = urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    items = tokens.join(F.broadcast(used) if size <= BROADCAST_BYTES else used, "token")
    held = items.groupBy("url").agg(F.collect_set("item").alias("have"))
    return (
        held.withColumn("token", F.explode("have")).join(indexed(rules), "token")
        .where(F.size(F.array_except("need", "have")) == 0)
        .groupBy("url").agg(F.max("confidence").alias("confidence"))
    )


def url_filter(
    pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    min_count: int = 10, min_support: float = 0.0, min_confidence: float = 0.6,
) -> DataFrame:
    """(id, host, path, rule, verdict), one row per row of pages.

    rules are (block or allow, host, path prefix); the longest that fits decides. Else the verdict
    is block where a mined rule matches, else allow. labelled has url and bad. Null urls have an
    empty host and path and are allowed; with no labels nothing is mined.
    """
    url = F.col("url")
    given = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    judged = given.select(id_col, "url", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.select(id_col, "url", "host", "path", rule.alias("rule"), says.alias("says"))
    mined, members = mine_items(labelled, min_count, min_support, min_confidence)
    mined = materialised(mined)
    if mined.isEmpty():
        blocked = F.lit(False)
    else:
        open_urls = judged.where("says is null and url is not null").select("url").distinct()
        found = blocked_urls(open_urls, mined, members)
        judged, blocked = judged.join(found, "url", "left"), F.col("confidence").isNotNull()
    verdict = F.coalesce(F.col("says"), F.when(blocked, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"))
