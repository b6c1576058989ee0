"""Queries of the streams: files of a given table arrive in batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from groundshift.sources.fixtures import table
from groundshift.streaming import updates as U

from . import queries_articles as QA
from . import queries_scenes as QS
from .queries_store import TODAY
from .registry import ORACLES, query
from .scratch import scratch_dir


#: Batches in which a table arrives.
BATCHES = 4


def _arrivals(spark, df) -> tuple[str, str, str, int]:
    """(folder of files, schema, folder of the stream's state, files in a batch): ``BATCHES`` batches of as many files as the table is read in tasks.

    So a file is a fraction of what a task reads, whatever the table's size. Rows are dealt by all columns.
    """
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    at_once = max(1, df.rdd.getNumPartitions())
    df.repartition(BATCHES * at_once, *df.columns).write.parquet(f"{base}/in")
    return f"{base}/in", ", ".join(f"`{n}` {t}" for n, t in df.dtypes), f"{base}/state", at_once


@query(ORACLES["fuse_articles"])
def stream_articles(spark, sf_dir):
    source, schema, store, at_once = _arrivals(spark, table(spark, sf_dir, "articles"))
    out = U.stream_articles(spark, source, schema, store, QA._watches(spark, sf_dir), QA._ranks(spark), at_once)
    return out.withColumns({c: F.array_join(c, " " if c == "duplicates" else ",") for c in ("toponym", "thematic", "duplicates")})


@query(f"""select p.*, case when w then d end before_start, case when w then cast(d + 1 as date) end after_start, case when w then date '{TODAY}' end after_end
from ({ORACLES["select_usable_scene"]}) p join (select event_id, cast(ts as date) d, cast(ts as date) + 1 < date '{TODAY}' w from events) e on e.event_id = p.scene_id""")
def stream_scene_selection(spark, sf_dir):
    source, schema, store, at_once = _arrivals(spark, table(spark, sf_dir, "scenes"))
    return U.stream_scene_selection(spark, source, schema, store, QS._requests(spark, sf_dir), TODAY, at_once)
