"""Claims and articles reach their operators whole."""

from pyspark.sql import functions as F

from groundshift.plans import catalogue
from groundshift.sources.fixtures import read, table


def test_no_text_is_a_prefix(spark, sf):
    claims, articles = table(spark, sf, "claims"), table(spark, sf, "articles")
    turns = read(spark, sf, "conversations").selectExpr("conv_id brief_id", "cast(row_number() over (partition by conv_id order by turn) - 1 as int) seq", "text turn")
    met = claims.where("trim(text) <> ''").join(turns, ["brief_id", "seq"])
    assert met.count() and met.where(~F.startswith("text", "turn")).count() == 0
    assert met.where(F.length("turn") > 60).count() > 0
    assert articles.where("title is distinct from split_part(full_text, '.', 1)").count() == 0
    assert articles.where(F.length("title") > 120).count() > 0


def test_no_query_reads_cut_texts():
    for name, sql in catalogue.ORACLES.items():
        assert not name.startswith("whole_") and "left(text, " not in sql and ", 1), 120)" not in sql
