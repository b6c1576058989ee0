"""Benchmark items without an id contaminate as others do."""

import corpus_pipeline
from duck import plain

from groundshift.llm import queries


def test_item_without_id_is_a_hit_as_in_the_sql(spark, tmp_path):
    import duckdb

    passage = "one two three four five six seven eight nine ten eleven"
    items = [(None, passage), (None, "red green"), (7, "alpha beta gamma")]
    docs = [(1, f"So: {passage}, it says."), (2, "Red green alpha beta gamma"), (3, "nothing of it"), (4, "red green")]
    for name, rows in (("documents", docs), ("benchmark", items)):
        spark.createDataFrame(rows, ("doc_id" if name == "documents" else "item_id") + " long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries.op9_decontamination(spark, str(tmp_path)).collect()
    stage = dict(corpus_pipeline.STAGES)["benchmark"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [r["doc_id"] for r in stage.collect()] == [3]
    con = duckdb.connect()
    con.sql("create table benchmark (item_id bigint, text varchar)")
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", items)
    con.executemany("insert into documents values (?, ?)", docs)
    assert sorted(map(plain, got)) == sorted(map(plain, con.sql(queries.OP9_SQL).fetchall()))
    assert {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in got} == {1: (11, 0, True), 2: (5, 1, True), 3: (0, 0, False), 4: (2, 0, True)}
