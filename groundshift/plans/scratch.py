"""Tables written to the folder that the driver and the executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only in a local session that names none (tests) a temporary folder is made and set; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="groundshift-")
        spark.sparkContext.setCheckpointDir(_OWN_DIR[app])
    return _OWN_DIR[app]


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    Cuts the lineage, gives the optimizer true sizes, and outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def checked_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint for the smaller side of a join: broadcast up to ``limit`` counted rows, else merge."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")


#: Counted hot keys up to which their rows are broadcast.
HOT_BROADCAST = 400_000


def join_hot(rows: DataFrame, side: DataFrame, key: str, hot: str, how: str = "inner") -> DataFrame:
    """Join on ``key`` with a side that has a row for each key and knows which keys are ``hot`` (a condition on it).

    Rows of hot keys meet a broadcast of those, where they lie; all others, or all if more than
    ``HOT_BROADCAST`` keys are hot, are joined by merging. ``how`` is inner or left.
    """
    if not 0 < side.where(hot).limit(HOT_BROADCAST + 1).count() <= HOT_BROADCAST:
        return rows.join(side.hint("merge"), key, how)
    big = materialize(side.where(hot), "hot-keys")
    rest = rows.join(F.broadcast(big.select(key)), key, "left_anti").join(side.where(f"not coalesce({hot}, false)").hint("merge"), key, how)
    return rest.unionByName(rows.join(F.broadcast(big), key))


#: Rows that a task of ``dealt_semi`` sorts, some 150 bytes each. Spark's own choice goes by bytes, of which narrow rows take one or two.
ROWS_A_TASK = 500_000
_BUCKETS = 1 << 14


def dealt_semi(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """The distinct ``rows`` whose ``key`` is in ``side``, in tasks of about ``ROWS_A_TASK`` rows of both, however few bytes these take.

    Keys of more rows than that, at most one for each task, are found by counts of hashed buckets and then of the keys in
    crowded ones. Their rows meet a broadcast of those keys where they lie, and are dealt by all columns.
    """
    rows = rows.where(F.col(key).isNotNull())
    bucket = F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).alias("_bucket")
    buckets = materialize(rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")), "bucket-counts")
    n_rows = buckets.agg(F.sum("_n")).first()[0] or 0
    tasks = 1 + (n_rows + side.count()) // ROWS_A_TASK
    known = side.select(key)
    crowded = buckets.where(F.col("_n") > ROWS_A_TASK).select("_bucket")
    hot = None
    if not crowded.isEmpty():
        some = rows.select(key, bucket).join(F.broadcast(crowded), "_bucket")  # _BUCKETS rows at most
        hot = materialize(some.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROWS_A_TASK).select(key), "hot-keys")
        hot_rows = rows.join(F.broadcast(hot.join(known, key, "left_semi")), key, "left_semi").repartition(tasks, *rows.columns).distinct()
        rows, known = (df.join(F.broadcast(hot), key, "left_anti") for df in (rows, known))
    # an inner join: Spark would push a semi join below the repartition
    met = rows.repartition(tasks, key).join(known.repartition(tasks, key).distinct().hint("merge"), key).select(*rows.columns).distinct()
    return met if hot is None else met.unionByName(hot_rows.select(*met.columns))
