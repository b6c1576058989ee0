"""What one task sorts, reads or holds does not grow with the input."""

import re

from pyspark.sql import functions as F

from groundshift.operators import claims, store
from groundshift.plans import queries_streams, scratch
from groundshift.sources.fixtures import table


def test_detections_of_an_area_are_one_row_before_the_join(spark, capsys):
    """Two areas of 10,000 detections each, one that ran and one that never did: each task brings a row an area to the anti join."""
    areas = spark.range(4).selectExpr("cast(id as int) aoi_id")
    detections = spark.range(20_000).selectExpr("cast(id % 2 as int) aoi_id", "id detection_id")
    jobs = spark.createDataFrame([(2, "succeeded"), (2, "succeeded"), (3, "failed")], "aoi_id int, status string")
    out = store.zero_detection_audit(areas, detections, jobs)
    assert sorted(map(tuple, out.collect())) == [(2, "ran, found nothing"), (3, "never ran")]
    store.zero_detection_audit(areas, detections.hint("merge"), jobs).explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    right = re.split(r"Join LeftAnti", plan)[1].splitlines()[1:]
    depth = [len(re.match(r"[ :+|-]*", x).group()) for x in right]
    second = next(i for i in range(1, len(right)) if depth[i] == depth[0])
    assert right[second].lstrip(" :+|-").startswith("Aggregate"), plan


def test_files_of_a_stream_do_not_grow_with_the_table(spark, sf):
    """A table read in n tasks arrives in four batches of n files, so no file holds a fixed share of it."""
    articles = table(spark, sf, "articles")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        tasks = articles.rdd.getNumPartitions()
        source, schema, _, at_once = queries_streams._arrivals(spark, table(spark, sf, "articles"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = spark.read.schema(schema).parquet(source)
    sizes = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert tasks == at_once > 2 and sum(sizes) == articles.count() and max(sizes) < 0.25 * sum(sizes)
    assert rows.exceptAll(articles).isEmpty() and len(rows.inputFiles()) <= 4 * at_once


def test_tasks_of_the_evidence_join_are_dealt_by_rows(spark, monkeypatch):
    """30,000 narrow links, a detection that 4,000 claims cite, unknown ids, nulls, repeated rows and repeated detections: as a set
    says, and no task takes much more than the stated rows, whatever few bytes they have."""
    monkeypatch.setattr(scratch, "ROWS_A_TASK", 1000, raising=False)
    caught = []
    monkeypatch.setattr(claims, "materialize", lambda df, name: caught.append(df) or scratch.materialize(df, name))
    links = [(i, i // 2) for i in range(26_000)] + [(i, 5) for i in range(4000)] + [(1, None), (2, -7), (3, 1), (3, 1)]
    known = spark.range(0, 26_000, 3).selectExpr("id detection_id")
    known = known.unionByName(known.limit(50)).unionByName(spark.createDataFrame([(5,), (None,)], "detection_id long"))
    by_claim, by_detection = claims.evidence_index(spark.createDataFrame(links, "claim_id int, detection_id long"), known)
    want = {x for x in links if x[1] is not None and (x[1] == 5 or x[1] >= 0 and x[1] % 3 == 0)}
    assert {(r.claim_id, d) for r in by_claim.collect() for d in r.detections} == want == {(c, r.detection_id) for r in by_detection.collect() for c in r.claims}
    assert by_claim.select("claim_id").distinct().count() == len({c for c, _ in links}) == by_claim.count()
    found = caught[0]
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == len(want) and max(sizes) < 1000 and len(sizes) > 10
