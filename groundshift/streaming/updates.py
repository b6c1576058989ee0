"""Streams of arriving files that keep a result equal to the batch result over all of them.

What a key's rows amount to is kept in Spark's state store, by a streaming aggregate that holds one row a key; a
batch reads and writes the keys it touches, whatever has been stored before. The rows that a batch changes are appended
under its number, so that one that runs again after a failure overwrites itself; the newest row of a key counts.
No row is late: an old one merely competes again for its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from groundshift.functions.columns import title_key
from groundshift.operators.articles import article_candidates, gated
from groundshift.operators.ranking import paged
from groundshift.operators.scenes import requested_scenes
from groundshift.operators.store import recheck_windows


def _drain(stream: DataStreamWriter, store: str, name: str, write) -> None:
    """Run a stream over all that is there; its progress is in ``store``."""
    stream.foreachBatch(write).option("checkpointLocation", f"{store}/progress-{name}").trigger(availableNow=True).start().awaitTermination()


def _arriving(spark: SparkSession, source: str, schema: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(source)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all batches with their number; none if no batch has come."""
    return spark.read.schema(schema + ", batch int").option("basePath", path).option("ignoreMissingFiles", "true").parquet(path)


def best_of_keys(spark: SparkSession, rows: DataFrame, keys: list[str], order: Column, store: str, name: str) -> DataFrame:
    """The least row by ``order`` of each key over all rows that the stream ``rows`` has brought.

    The aggregate's state is one row a key. Each batch appends the keys whose row changed; the result is the newest of them.
    """
    names = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), order).alias("best")).select(*keys, "best.*")
    path = f"{store}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _drain(best.writeStream.outputMode("update"), store, name, write)
    changes = _stored(spark, path, ", ".join(f"`{n}` {t}" for n, t in best.dtypes))
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("best")).select(*keys, "best.*")


def stream_articles(spark: SparkSession, source: str, schema: str, store: str, watches: DataFrame, ranks: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """Admitted articles of every watch after all files: gated and deduplicated per area.

    A batch is gated on its own and its admitted articles are stored. A second stream over those keeps the best
    article of each area and title key. The other urls of a key are read from the admitted rows when the result is.
    """
    admitted = f"{store}/admitted"
    columns = "aoi_id int, title_key string, domain_rank int, seendate timestamp, article_id long, url string, title string, domain string, language string, toponym array<string>, thematic array<string>"

    def gate(batch: DataFrame, number: int) -> None:
        passed = gated(article_candidates(batch, watches), watches).where("gate.passed")
        ranked = passed.join(ranks.hint("merge"), "domain", "left").withColumn("domain_rank", F.coalesce("domain_rank", F.lit(1 << 30)))
        rows = ranked.select("aoi_id", title_key(F.col("title")).alias("title_key"), "domain_rank", "seendate", "article_id", "url", "title", "domain", "language", F.col("gate.toponym").alias("toponym"), F.col("gate.thematic").alias("thematic"))
        rows.write.mode("overwrite").parquet(f"{admitted}/batch={number}")

    _drain(_arriving(spark, source, schema, files_per_batch).writeStream, store, "gates", gate)
    order = F.struct("domain_rank", "seendate", "article_id", "url")
    winners = best_of_keys(spark, _arriving(spark, admitted, columns, 1 << 20), ["aoi_id", "title_key"], order, store, "winners")
    other = _stored(spark, admitted, columns).join(winners.select("aoi_id", "title_key", F.col("article_id").alias("first_id"), F.col("url").alias("first_url")).hint("merge"), ["aoi_id", "title_key"])
    other = other.where("article_id <> first_id or url <> first_url")
    nested = paged(other, ["aoi_id", "title_key"], [F.col("domain_rank"), F.col("seendate"), F.col("article_id")], F.col("url"), "duplicates").drop("first")
    out = winners.join(nested.hint("merge"), ["aoi_id", "title_key"], "left")
    return out.select("aoi_id", "article_id", "url", "title", "domain", "language", "seendate", "toponym", "thematic", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("duplicates", F.array().cast("array<string>")).alias("duplicates"))


def stream_scene_selection(spark: SparkSession, source: str, schema: str, store: str, requests: DataFrame, today=None, files_per_batch: int = 1) -> DataFrame:
    """Each area's best usable scene after all files, and the re-check that it asks for.

    With ``today`` the rows have before_start, after_start and after_end, the windows of the request to look
    again from the scene's day on; null where the day after is not over.
    """
    met = requested_scenes(_arriving(spark, source, schema, files_per_batch), requests)
    rows = met.select("aoi_id", "scene_id", "step", "cloud_pct", "usable_fraction", "captured_at")
    best = best_of_keys(spark, rows, ["aoi_id"], F.struct("step", "cloud_pct", "captured_at", "scene_id"), store, "scenes")
    if today is None:
        return best.drop("captured_at")
    asked = recheck_windows(best, today)
    return best.drop("captured_at").join(asked.hint("merge"), "aoi_id", "left")
