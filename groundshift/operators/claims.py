"""Claim validation: every claim of a brief against the rows it cites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundshift.functions.columns import OBSERVED, REPORTED, area_mentions, has_quantity, iso_date, iso_mentions, month_mentions
from groundshift.plans.scratch import dealt_semi, materialize

from .ranking import PAGE, paged

CLAIM_TYPES = ("observed", "context", "reported", "mixed")
AREA_TOLERANCE = 0.10
MAX_ATTEMPTS = 3
PROMPT_DETECTIONS, PROMPT_ARTICLES = 50, 10
KEY = ("brief_id", "seq")


def claims_exploded(drafts: DataFrame) -> DataFrame:
    """Drafts with an array of claims to one row per claim; an empty draft keeps a row without one."""
    return drafts.select("brief_id", F.posexplode_outer("claims").alias("seq", "c")).select("brief_id", "seq", "c.*")


def _violation(rows: DataFrame, code: str, detail: Column | None = None) -> DataFrame:
    return rows.select(*KEY, F.lit(code).alias("code"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def _checkable(claims: DataFrame) -> DataFrame:
    return claims.where((F.trim("text") != "") & F.col("claim_type").isin(*CLAIM_TYPES))


def structure_violations(claims: DataFrame, briefs: DataFrame) -> DataFrame:
    """empty_brief, blank_claim, unsupported_claim_type."""
    empty = briefs.join(claims.select("brief_id").distinct(), "brief_id", "left_anti").select("brief_id", F.lit(None).cast("int").alias("seq"), F.lit("empty_brief").alias("code"), F.lit(None).cast("string").alias("detail"))
    blank = _violation(claims.where(F.trim("text") == ""), "blank_claim")
    kind = _violation(claims.where((F.trim("text") != "") & ~F.col("claim_type").isin(*CLAIM_TYPES)), "unsupported_claim_type", F.col("claim_type"))
    return empty.unionByName(blank).unionByName(kind)


def _both(c: str = "claim_type") -> Column:
    return (F.col(c) == "mixed") & (F.size("evidence") > 0) & (F.size("article_evidence") > 0)


def linkage_violations(claims: DataFrame, known_detections: DataFrame, known_articles: DataFrame) -> DataFrame:
    """Missing, misplaced and unknown links; an unknown id counts once per mention.

    ``known_*`` hold (brief_id, id) of the rows a brief may cite.
    """
    rows = _checkable(claims)
    t, no_det, no_art = F.col("claim_type"), F.size("evidence") == 0, F.size("article_evidence") == 0
    parts = [
        _violation(rows.where((t == "observed") & no_det), "unlinked_claim"),
        _violation(rows.where((t == "observed") & ~no_art), "article_evidence_on_observed_claim"),
        _violation(rows.where((t == "reported") & no_art), "unlinked_reported_claim"),
        _violation(rows.where((t == "mixed") & (no_det | no_art)), "mixed_claim_missing_side"),
    ]
    cited = rows.where((t == "observed") | _both()).select(*KEY, F.explode("evidence").alias("id"))
    parts.append(_violation(cited.join(known_detections.hint("merge"), ["brief_id", "id"], "left_anti"), "unknown_evidence_id", F.col("id")))
    cited = rows.where(t.isin("reported", "mixed")).select(*KEY, F.explode("article_evidence").alias("id"))
    parts.append(_violation(cited.join(known_articles.hint("merge"), ["brief_id", "id"], "left_anti"), "unknown_article_id", F.col("id")))
    return reduce(DataFrame.unionByName, parts)


def quantity_violations(claims: DataFrame) -> DataFrame:
    rows = _checkable(claims).where(has_quantity(F.col("text")))
    return _violation(rows.where("claim_type = 'context'"), "quantified_context_claim").unionByName(_violation(rows.where("claim_type = 'reported'"), "quantified_reported_claim"))


def framing_violations(claims: DataFrame) -> DataFrame:
    """Reported claims with observational wording or without reported wording."""
    bad = F.rlike("text", F.lit("(?i)" + OBSERVED)) | ~F.rlike("text", F.lit("(?i)" + REPORTED))
    return _violation(_checkable(claims).where((F.col("claim_type") == "reported") & bad), "observational_framing_on_reported_claim")


def linked_areas(claims: DataFrame, known_detections: DataFrame) -> DataFrame:
    """brief_id, seq, linked_area: the sum over the distinct known detections a claim cites."""
    cited = _checkable(claims).where((F.col("claim_type") == "observed") | _both()).select(*KEY, F.explode(F.array_distinct("evidence")).alias("id"))
    return cited.join(known_detections.select("brief_id", "id", "area_m2").dropDuplicates(["brief_id", "id"]).hint("merge"), ["brief_id", "id"]).groupBy(*KEY).agg(F.sum("area_m2").alias("linked_area"))


def area_violations(claims: DataFrame, known_detections: DataFrame) -> DataFrame:
    """Quoted areas more than a tenth off the claim's linked area."""
    quoted = _checkable(claims).select(*KEY, F.explode(area_mentions(F.col("text"))).alias("quoted"))
    off = quoted.join(linked_areas(claims, known_detections).hint("merge"), list(KEY)).where(F.abs(F.col("quoted") - F.col("linked_area")) > AREA_TOLERANCE * F.col("linked_area"))
    return _violation(off, "area_mismatch", F.round("quoted", 3).cast("decimal(20,3)"))


def date_violations(claims: DataFrame, briefs: DataFrame) -> DataFrame:
    """ISO dates and months that are neither scene's; observed claims always, mixed with both sides."""
    rows = _checkable(claims).where((F.col("claim_type") == "observed") | _both()).join(briefs.select("brief_id", "before_date", "after_date"), "brief_id")
    iso = rows.select(*KEY, "before_date", "after_date", F.explode(iso_mentions(F.col("text"))).alias("m"))
    day = iso_date(F.col("m"))
    wrong = iso.where(F.coalesce((day != F.col("before_date")) & (day != F.col("after_date")), F.lit(True)))
    month = rows.select(*KEY, "before_date", "after_date", F.explode(month_mentions(F.col("text"))).alias("m"))
    of = lambda c: F.year(c) * 100 + F.month(c)
    off = month.where((F.col("m") != of("before_date")) & (F.col("m") != of("after_date")))
    return _violation(wrong, "date_mismatch", F.col("m")).unionByName(_violation(off, "date_mismatch", F.col("m")))


def validate_briefs(claims: DataFrame, briefs: DataFrame, known_detections: DataFrame, known_articles: DataFrame) -> DataFrame:
    """All violations, one row each; a brief without any is valid."""
    return reduce(DataFrame.unionByName, [
        structure_violations(claims, briefs), linkage_violations(claims, known_detections, known_articles), quantity_violations(claims), framing_violations(claims),
        area_violations(claims, known_detections), date_violations(claims, briefs),
    ])


def resolve_attempts(attempts: DataFrame, violations: DataFrame, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """group_id, status, attempts, tokens: validated at the first clean attempt within the limit, else rejected.

    ``attempts`` has group_id, attempt, brief_id and tokens; tokens are summed over the attempts used.
    """
    within = attempts.where(F.col("attempt") <= limit)
    bad = violations.select("brief_id").distinct().withColumn("bad", F.lit(True))
    judged = within.join(bad.hint("merge"), "brief_id", "left")
    first = judged.groupBy("group_id").agg(F.min(F.when(F.col("bad").isNull(), F.col("attempt"))).alias("won"), F.max("attempt").alias("made"))
    used = judged.join(first, "group_id").where("attempt <= coalesce(won, made)")
    return used.groupBy("group_id").agg(F.when(F.max("won").isNotNull(), "validated").otherwise("rejected").alias("status"), F.coalesce(F.max("won"), F.max("made")).alias("attempts"), F.sum("tokens").alias("tokens"))


_PAIR = ("aoi_id", "before_scene_id", "after_scene_id")


def _lines(rows: DataFrame, keys, order: list[Column], line: Column, limit: int) -> DataFrame:
    """keys and lines: the first ``limit`` rows of each key as text; Spark limits each key's rows before they are shuffled."""
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= limit)
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def _fixed(value: Column, digits: int) -> Column:
    """A number of no less than 0 with so many decimals."""
    scaled = F.round(value * 10**digits).cast("long")
    return F.concat(F.floor(scaled / 10**digits).cast("string"), F.lit("."), F.lpad((scaled % 10**digits).cast("string"), digits, "0"))


def detection_context(detections: DataFrame, keys=_PAIR) -> DataFrame:
    """Per pair: count, total area, counts by type, and the largest detections as lines.

    Totals cover all detections, lines the ``PROMPT_DETECTIONS`` largest.
    """
    totals = detections.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area_m2"), 2).alias("total_area"))
    types = detections.groupBy(*keys, "change_type").agg(F.count(F.lit(1)).alias("k"))
    types = types.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("change_type", "k"))), lambda t: F.concat_ws("=", t["change_type"], t["k"].cast("string"))), ", ").alias("by_type"))
    parts = ("id=", F.col("detection_id").cast("string"), " type=", F.col("change_type"), " area_m2=", F.round("area_m2").cast("long").cast("string"), " magnitude=", _fixed(F.col("magnitude"), 3), " confidence=", _fixed(F.col("confidence"), 2))
    line = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return totals.join(types, list(keys)).join(_lines(detections, keys, [F.desc("area_m2"), F.col("detection_id")], line, PROMPT_DETECTIONS), list(keys))


def article_context(articles: DataFrame, keys=("aoi_id",)) -> DataFrame:
    """Per area: number of articles and the ``PROMPT_ARTICLES`` earliest as lines; further pages of an article's duplicates do not count."""
    articles = articles.where("page = 0") if "page" in articles.columns else articles
    line = F.concat(F.lit("["), F.col("article_id").cast("string"), F.lit("] "), F.date_format("seendate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), F.col("domain"), F.lit(": "), F.col("title"))
    found = articles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_articles"))
    return found.join(_lines(articles, keys, [F.col("seendate"), F.col("article_id")], line, PROMPT_ARTICLES).withColumnRenamed("lines", "article_lines"), list(keys))


def brief_context(briefs: DataFrame, detections: DataFrame, articles: DataFrame) -> DataFrame:
    """What a brief is written from: brief_id, n, total_area, by_type, lines, n_articles, article_lines.

    ``briefs`` has brief_id, aoi_id and the pair's scenes; ``articles`` are the admitted ones of each area
    (``articles.fuse_articles``). Contexts are made once a pair and area, whatever the number of its briefs. Totals cover all rows, lines the
    largest detections and the earliest articles. A brief without any has zeros and empty texts.
    """
    d = detection_context(detections).hint("merge")
    out = briefs.select("brief_id", *_PAIR).join(d, list(_PAIR), "left").join(article_context(articles).hint("merge"), "aoi_id", "left")
    zero, text = F.lit(0).cast("long"), F.lit("")
    return out.select("brief_id", F.coalesce("n", zero).alias("n"), F.coalesce("total_area", F.lit(0.0)).alias("total_area"), F.coalesce("by_type", text).alias("by_type"), F.coalesce("lines", text).alias("lines"),
                      F.coalesce("n_articles", zero).alias("n_articles"), F.coalesce("article_lines", text).alias("article_lines"))


def persist_claims(claims: DataFrame, briefs: DataFrame) -> DataFrame:
    """Typed evidence links of validated briefs: brief_id, seq, evidence_type, detection_id, article_id."""
    rows = claims.join(briefs.where("status = 'validated'").select("brief_id"), "brief_id", "left_semi")
    d = rows.select(*KEY, F.lit("detection").alias("evidence_type"), F.explode("evidence").alias("detection_id"), F.lit(None).cast("long").alias("article_id"))
    a = rows.select(*KEY, F.lit("article").alias("evidence_type"), F.lit(None).cast("long").alias("detection_id"), F.explode("article_evidence").alias("article_id"))
    return d.unionByName(a)


def stale_briefs(briefs: DataFrame, replaced: DataFrame) -> DataFrame:
    """Briefs with the status after the given pairs were detected anew: validated ones of those pairs are stale."""
    marks = replaced.select("aoi_id", "before_scene_id", "after_scene_id").distinct().withColumn("hit", F.lit(True))
    met = briefs.join(marks, ["aoi_id", "before_scene_id", "after_scene_id"], "left")
    return met.select(*[c for c in briefs.columns if c != "status"], F.when(F.col("hit") & (F.col("status") == "validated"), "stale").otherwise(F.col("status")).alias("status"))


def latest_validated_brief(briefs: DataFrame) -> DataFrame:
    order = Window.partitionBy("aoi_id").orderBy(F.desc("created_at"), F.desc("brief_id"))
    return briefs.where("status = 'validated'").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def claims_with_evidence(claims: DataFrame, briefs: DataFrame, links: DataFrame, page_size: int = PAGE) -> DataFrame:
    """Claims of validated or stale briefs with their links, sorted, as an array, a row for each page of ``page_size`` links; a claim without any has an empty page 0."""
    shown = claims.join(briefs.where("status in ('validated', 'stale')").select("brief_id"), "brief_id", "left_semi")
    label = F.concat_ws(":", "evidence_type", F.coalesce("detection_id", "article_id").cast("string"))
    nested = paged(links, list(KEY), [], label, "links", page_size).drop("first")
    return shown.join(nested.hint("merge"), list(KEY), "left").select(*KEY, F.coalesce("page", F.lit(0)).alias("page"), "claim_type", F.coalesce("links", F.array().cast("array<string>")).alias("links"))


def evidence_index(links: DataFrame, detections: DataFrame, page_size: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """(claim to its known detections, detection to its claims), a row for each page of ``page_size``; a claim with none keeps an empty page 0."""
    known = materialize(dealt_semi(links.select("claim_id", "detection_id"), detections, "detection_id"), "known-links")
    claims = links.select("claim_id").distinct()
    by_claim = claims.join(paged(known, ["claim_id"], [], F.col("detection_id"), "detections", page_size).hint("merge"), "claim_id", "left")
    by_claim = by_claim.select("claim_id", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("detections", F.array().cast("array<bigint>")).alias("detections"))
    return by_claim, paged(known, ["detection_id"], [], F.col("claim_id"), "claims", page_size).drop("first")
