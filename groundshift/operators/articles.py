"""Article correlation: candidates in place and time, ordered gates, syndication dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundshift.functions.columns import holds_term, normalize_text, title_key
from groundshift.plans.scratch import checked_side, materialize

from .ranking import PAGE, paged, placed

#: Days before, after, and of the longest look-back (fixed values).
LEAD_DAYS, LAG_DAYS, LOOKBACK_DAYS = 30, 14, 400
WATCHES_BROADCAST = 1000
#: Terms of a term dictionary up to which it is broadcast (each some hundred bytes at most).
TERMS_BROADCAST = 100_000
DEALS = 64
_RUN = "[0-9a-z]+"


def fusion_window(pairs: DataFrame) -> DataFrame:
    """pairs with window_start and window_end around the before and after times."""
    start = F.greatest("before_at", F.col("after_at") - F.make_dt_interval(F.lit(LOOKBACK_DAYS))) - F.make_dt_interval(F.lit(LEAD_DAYS))
    return pairs.withColumns({"window_start": start, "window_end": F.col("after_at") + F.make_dt_interval(F.lit(LAG_DAYS))})


def retrieval_query(place_term: Column, themes: Column) -> Column:
    """The query text recorded for audit: the strict place term and any of the themes."""
    return F.concat(F.lit('"'), place_term, F.lit('" ('), F.array_join(F.transform(themes, lambda t: F.concat(F.lit("theme:"), t)), " OR "), F.lit(")"))


def article_candidates(articles: DataFrame, watches: DataFrame) -> DataFrame:
    """Articles within a watch's window whose full text holds its first place term.

    ``watches`` (aoi_id, place_terms, window_start, window_end, ...) is the small side: one row per
    area under watch, broadcast up to ``WATCHES_BROADCAST`` of them. The range join on the time
    seen is bucketed by month, so it is an equi-join whatever their number. Watches without terms
    find nothing.
    """
    months = F.sequence(F.trunc("window_start", "month"), F.trunc("window_end", "month"), F.expr("interval 1 month"))
    w = watches.where(F.size("place_terms") > 0).select("*", F.explode(months).alias("_month"))
    met = articles.withColumn("_month", F.trunc("seendate", "month")).join(checked_side(w, watches.count(), WATCHES_BROADCAST), "_month")
    return met.where("seendate between window_start and window_end").where(F.contains(F.lower("full_text"), F.lower(F.get("place_terms", 0)))).drop("_month")


def vocabulary() -> Column:
    """Names a watch's terms; watches with equal ones share it."""
    return F.md5(F.to_json(F.struct(F.concat("place_terms", "region_terms").alias("names"), "stems")).cast("binary"))


def term_dictionary(watches: DataFrame) -> DataFrame:
    """vocabulary, stem (boolean), place, term, needle and key of every term: the index in which titles look terms up.

    ``needle`` is the folded term. ``key`` is what a title must have for it: the first run of letters and digits as a word,
    or as the beginning of one where a stem ends with it, led by its length; terms without such a run have an empty key.
    """
    v = watches.select(vocabulary().alias("vocabulary"), F.concat("place_terms", "region_terms").alias("names"), "stems").dropDuplicates(["vocabulary"])
    each = v.select("vocabulary", F.lit(False).alias("stem"), F.posexplode("names").alias("place", "term")).unionByName(v.select("vocabulary", F.lit(True).alias("stem"), F.posexplode("stems").alias("place", "term")))
    each = each.withColumn("needle", normalize_text(F.col("term"))).where("needle <> ''")
    run = F.regexp_extract("needle", _RUN, 0)
    open_end = F.col("stem") & F.endswith("needle", run) & ~F.rlike(F.col("needle"), F.lit(_RUN + "[^0-9a-z]+" + _RUN))
    return each.withColumn("key", F.when(run == "", "").when(open_end, F.concat(F.length(run).cast("string"), F.lit("-"), run)).otherwise(F.concat(F.lit("="), run)))


def term_hits(rows: DataFrame, watches: DataFrame) -> DataFrame:
    """``rows`` with toponym and thematic, the terms and stems of the row's watch in its title, in their order and spelling.

    ``rows`` has title, place_terms, region_terms and stems. Each different title is folded once and taken apart into its
    words, and their beginnings of those lengths that stems have; these meet the dictionary in an equi-join, and only what
    meets is compared. The work of a title grows with its words and the terms it has, not with all terms.
    A null title has none. Broadcast: the dictionary, up to ``TERMS_BROADCAST`` counted terms.
    """
    terms = materialize(term_dictionary(watches), "article-terms")
    n_terms = terms.count()
    starts = sorted(int(r["n"]) for r in terms.where("key rlike '^[0-9]'").select(F.split_part("key", F.lit("-"), F.lit(1)).alias("n")).distinct().collect())  # a row for each length
    titles = rows.where("title is not null").select("title", vocabulary().alias("vocabulary")).distinct()
    titles = titles.groupBy("title").agg(F.collect_set("vocabulary").alias("asked")).withColumn("hay", normalize_text(F.col("title")))  # as many as there are watches at most
    words = F.array_distinct(F.regexp_extract_all("hay", F.lit(_RUN), F.lit(0)))
    keys = [F.transform(words, lambda w: F.concat(F.lit("="), w)), F.array(F.lit(""))]
    keys += [_beginnings(words, n) for n in starts]
    keyed = titles.select("title", "hay", "asked", F.explode(F.array_distinct(F.concat(*keys))).alias("key"))
    met = keyed.join(checked_side(terms, n_terms, TERMS_BROADCAST), "key").where(F.array_contains("asked", F.col("vocabulary")))
    sure = F.col("key").isin("") | (F.length("needle") != F.length(F.regexp_extract("needle", _RUN, 0)))
    met = met.where(~sure | F.when(F.col("stem"), holds_term(F.col("hay"), F.col("needle"), False)).otherwise(holds_term(F.col("hay"), F.col("needle"), True)))
    hits = met.groupBy("title", "vocabulary").agg(F.array_sort(F.collect_list(F.when(~F.col("stem"), F.struct("place", "term")))).alias("toponym"), F.array_sort(F.collect_list(F.when(F.col("stem"), F.struct("place", "term")))).alias("thematic"))
    hits = materialize(hits.select("title", F.col("vocabulary").alias("_vocabulary"), F.col("toponym.term").alias("toponym"), F.col("thematic.term").alias("thematic")), "article-hits")
    none = F.array().cast("array<string>")
    out = rows.withColumn("_vocabulary", vocabulary()).join(hits.hint("merge"), ["title", "_vocabulary"], "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("toponym", none).alias("toponym"), F.coalesce("thematic", none).alias("thematic"))


def _beginnings(words: Column, n: int) -> Column:
    """The first ``n`` letters of each word that has them, led by their number."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.lit(f"{n}-"), F.left(w, F.lit(n))))


def gated(rows: DataFrame, watches: DataFrame) -> DataFrame:
    """``rows`` of articles under watches with ``gate``, a struct (passed, toponym, temporal, thematic, reason).

    Gates in order: language, url, toponym, temporal, thematic; the first that fails is the reason,
    and terms matched up to there are kept.
    """
    found = term_hits(rows, watches)
    toponym, thematic = F.col("toponym"), F.col("thematic")
    inside = F.col("seendate").between(F.col("window_start"), F.col("window_end"))
    reason = (
        F.when(~F.coalesce(F.array_contains("languages", F.col("language")), F.lit(False)), "language").when(~(F.col("url").startswith("http://") | F.col("url").startswith("https://")), "url")
        .when(F.size(toponym) == 0, "toponym").when(~inside, "temporal").when(F.size(thematic) == 0, "thematic")
    )
    none = F.array().cast("array<string>")
    early = F.coalesce(reason.isin("language", "url"), F.lit(False))
    gate = F.struct(
        reason.isNull().alias("passed"), F.when(early, none).otherwise(toponym).alias("toponym"), F.coalesce(reason.isNull() | (reason == "thematic"), F.lit(False)).alias("temporal"),
        F.when(reason.isNull(), thematic).otherwise(none).alias("thematic"), reason.alias("reason"),
    )
    return found.withColumn("gate", gate).drop("toponym", "thematic")


def score_articles(articles: DataFrame, watches: DataFrame) -> DataFrame:
    """Every article with its gate outcome under every watch of its area.

    Articles that carry an aoi_id meet the watches of that area. Articles without one meet all
    watches, a stated query set, in blocks of about ``WATCHES_BROADCAST``: every article goes to
    each block once, and a block's watches lie in ``DEALS`` parts of the articles. One block is broadcast.
    """
    n = watches.count()
    if "aoi_id" in articles.columns:
        met = articles.join(checked_side(watches, n, WATCHES_BROADCAST), "aoi_id")
    elif n <= WATCHES_BROADCAST:
        met = articles.join(F.broadcast(watches))
    else:
        blocks = -(-n // WATCHES_BROADCAST)
        dealt = articles.select("*", F.pmod(F.xxhash64("article_id"), F.lit(DEALS)).alias("_deal"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
        query = watches.select("*", F.pmod(F.xxhash64("aoi_id", "window_start"), F.lit(blocks)).cast("int").alias("_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))).alias("_deal"))
        met = dealt.join(query.hint("merge"), ["_block", "_deal"]).drop("_block", "_deal")
    return gated(met, watches)


def dedupe_articles(rows: DataFrame, ranks: DataFrame, keys=("aoi_id",), page_size: int = PAGE) -> DataFrame:
    """One article per title key: best ranked domain, unranked last, then earliest, then id: keys, title_key, page, article_id, duplicates.

    ``ranks`` has domain and domain_rank. The other urls are kept, in that order, as ``duplicates``; a title key with more
    than ``page_size`` of them has further pages of them (page 1, 2, ...) under the same article_id, none made in one task.
    """
    ranked = rows.withColumn("title_key", title_key(F.col("title"))).join(ranks.hint("merge"), "domain", "left")
    order = [F.coalesce("domain_rank", F.lit(1 << 30)).alias("rank"), F.col("seendate"), F.col("article_id").alias("id"), F.col("url").alias("address")]
    groups = paged(ranked, [*keys, "title_key"], order, F.struct("article_id", "url"), size=page_size, lead=1)
    urls = F.transform("items", lambda x: x["url"])
    return groups.select(*keys, "title_key", "page", F.col("first.article_id").alias("article_id"), F.when(F.col("page") == 0, F.slice(urls, 2, page_size)).otherwise(urls).alias("duplicates"))


def fuse_articles(articles: DataFrame, watches: DataFrame, ranks: DataFrame) -> DataFrame:
    """Admitted articles of every watch: candidates, gates, then dedup; with gates and duplicates as meta.

    An article has a row for each page of its duplicates: one, page 0, unless there are more than ``PAGE``.
    """
    passed = materialize(gated(article_candidates(articles, watches), watches).where("gate.passed"), "article-passed")
    kept = dedupe_articles(passed, ranks)
    rows = passed.join(kept.hint("merge"), ["aoi_id", "article_id"])
    return rows.select("aoi_id", "article_id", "url", "title", "domain", "language", "seendate", F.col("gate.toponym").alias("toponym"), F.col("gate.thematic").alias("thematic"), "page", "duplicates")


def gate_funnel(scored: DataFrame) -> DataFrame:
    """Per area: candidates, admitted, and rejections by reason."""
    named = lambda r: F.count_if(F.col("gate.reason") == r).alias(f"rejected_{r}")
    return scored.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("gate.passed").alias("admitted"), *[named(r) for r in ("language", "url", "toponym", "temporal", "thematic")])


def articles_for_pair(fused: DataFrame) -> DataFrame:
    """Admitted articles with their place, oldest first."""
    return placed(fused.where("page = 0").drop("page"), ["aoi_id"], [F.col("seendate"), F.col("article_id")])
