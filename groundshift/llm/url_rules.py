"""URL filters, in DataFrame functions only: given host and path rules, and association rules.

FP-growth mines combinations of URL tokens that go with the label; rules of enough support and
confidence block a URL that holds all their tokens. Tokens that occur in the same labelled URLs are one
item, and rules that a shorter one of no less confidence covers are pruned. Rules are found
through an inverted index with one posting per rule, under its rarest token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_SUPPORT = 0.002
#: Least labelled URLs behind a rule, at any size of the table.
LEAST_URLS = 10
MIN_CONFIDENCE = 0.6
BLOCK = "label=block"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host, path segments and query keys, digits as one ``0``."""
    bare = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    hosts = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("host:"), bare(x)))
    paths = F.transform(F.split(path_of(url), "/"), lambda x: F.concat(F.lit("path:"), bare(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), bare(F.substring_index(x, "=", 1))))
    every = F.concat(hosts, paths, keys)
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: ~F.array_contains(F.array(*[F.lit(k + ":") for k in ("host", "path", "query")]), x))))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens and blocked of the pages whose document has a label; the number in the path names it."""
    named = pages.select(F.expr("try_cast(regexp_extract(url, '/([0-9]+)[^/]*/?(?:[?#].*)?$', 1) as bigint)").alias("doc_id"), url_tokens(F.col("url")).alias("tokens"))
    bad = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("blocked"))
    return named.where("doc_id is not null").join(bad.hint("merge"), "doc_id").select("tokens", "blocked")


def token_classes(labelled: DataFrame, least: int = LEAST_URLS) -> DataFrame:
    """(token, item) of the tokens of at least ``least`` labelled URLs; tokens of the very same URLs share an item.

    The tokens of one long URL that is repeated are then one item and not its every subset; a rule
    with any of them holds for all. Sets of URLs are told apart by their size and 128 bits of hashes.
    """
    rows = labelled.select("url_no", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "url_no")).alias(f"x{seed}") for seed in (0, 1)]
    sets = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *marks).where(F.col("n") >= least), "url-tokens")
    items = sets.groupBy("n", "x0", "x1").agg(F.min("token").alias("item"))
    return materialize(sets.join(items.hint("merge"), ["n", "x0", "x1"]).select("token", "item"), "url-items")


def as_items(token_sets: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and items (a sorted array) of every row with a token that has one; ``keys`` tell rows apart."""
    rows = token_sets.select(*keys, F.explode("tokens").alias("token")).join(classes.hint("merge"), "token")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules that block: items (array), rarest (its index item), confidence, support.

    ``labelled`` has items and blocked. FP-growth itself counts on the executors; what reaches the driver is
    the list of items of at least ``min_support``, of which a URL of t items can carry t, so at most
    t / min_support of them. A rule stays only if none with a part of its items is as confident.
    """
    items = labelled.select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    freq = materialize(model.freqItemsets, "url-itemsets")
    singles = freq.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK)).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    ranked = rules.select("*", F.explode("items").alias("item")).join(singles.hint("merge"), "item")
    ranked = materialize(ranked.groupBy("items", "confidence", "support").agg(F.min(F.struct("freq", "item"))["item"].alias("rarest")), "url-rules")
    shorter = ranked.select("rarest", F.col("items").alias("part"), F.col("confidence").alias("part_confidence"))
    held = ranked.select("items", "confidence", F.explode("items").alias("rarest")).join(shorter.hint("merge"), "rarest")
    held = held.where((F.size("part") < F.size("items")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0))
    return ranked.join(held.select("items").distinct().hint("merge"), "items", "left_anti")


def match_rules(item_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """confidence of the best rule that fits each of the distinct ``items``; sets without one are left out."""
    postings = item_sets.select("items", F.explode("items").alias("rarest")).join(rules.select("rarest", F.col("items").alias("needed"), "confidence").hint("merge"), "rarest")
    fits = postings.where(F.size(F.array_except("needed", "items")) == 0)
    return fits.groupBy("items").agg(F.max("confidence").alias("confidence"))


def given_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (size, rule, verdict) of the longest of the given rules that fits, or null.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    fits = []
    for verdict, rule_host, rule_path in rules:
        text = rule_host + rule_path
        on = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        fits.append(F.when(on, F.struct(F.lit(len(text)).alias("size"), F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Verdict on every URL: page_id, host, path, rule, verdict, confidence.

    Given rules decide first, the longest that fits. Elsewhere a mined rule blocks and all others
    are allowed; ``confidence`` is that of the best mined rule, null where none fits. A mined rule has at
    least ``LEAST_URLS`` labelled URLs and ``min_support`` of them behind it. A null URL or
    one without ``://`` has an empty host and path, and is allowed. Without labels, or with too few, there are no
    mined rules; labels without id or quality say nothing. Repeated rows are judged alike, each on its own row. Other columns are ignored.
    URLs are first grouped to distinct token sets; only those meet the rules.
    """
    labelled = materialize(labelled_urls(pages, labels).withColumn("url_no", F.monotonically_increasing_id()), "url-labelled")
    n_labelled = labelled.count()
    classes = token_classes(labelled)
    itemised = labelled.select("url_no", "blocked").join(as_items(labelled, classes, ["url_no"]).hint("merge"), "url_no", "left")
    itemised = itemised.select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "blocked")
    mined = materialize(mine_rules(materialize(itemised, "url-itemised"), min(1.0, max(min_support, LEAST_URLS / max(n_labelled, 1))), min_confidence), "url-mined")
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_tokens(F.col("url")).alias("tokens"))
    sets = materialize(as_items(seen.select("tokens").distinct(), classes, ["tokens"]), "url-sets")
    found = match_rules(sets.select("items").distinct(), mined)
    sets = materialize(sets.join(found.hint("merge"), "items").select("tokens", "confidence"), "url-matches")
    seen = seen.join(sets.hint("merge"), "tokens", "left").withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return seen.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), "confidence")
