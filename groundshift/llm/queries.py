"""Registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, mixing, near_join, quality, simhash, token_alignment, token_counts, toxicity, turn_repair, unit_dedup, url_rules, warc
from .common import table
from .turn_repair_sql import OP11_SQL


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"))


def op2_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.dedup_units(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), without_id=True)
    return found.selectExpr("doc_id", "n_words", "n_hit", "n_items", "sha2(array_join(item_ids, ','), 256) as items_sha256", "contaminated")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_near_join": op2_near_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_turn_repair": op11_turn_repair,
    "op12_toxicity": op12_toxicity,
    "op13_token_alignment": op13_token_alignment,
}

OP9_SQL = r"""
with iw as (
  select cast(item_id as varchar) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark where text is not null),
il as (select item, w, least(len(w), 10) n from iw where len(w) > 0),
win as (select distinct item, n, array_to_string(w[s:s + n - 1], ' ') win from (select item, w, n, unnest(range(1, len(w) - n + 2)) s from il)),
dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
lens as (select distinct n from win),
dwin as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from dw, lens)),
hits as (select doc_id, s, n, item from dwin join win using (n, win)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from (select distinct doc_id, s, n from hits)) group by doc_id),
its as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) ids from hits group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join pos using (doc_id) left join its using (doc_id)
"""

OP7_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) h, coalesce(html, '') body from pages),
r as (select *, max(page_id) over (partition by h) top from p)
select page_id, cast(n as bigint) payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, 1 + 5 * (i // 4), 5) as bigint) // (32 ** (3 - i % 4))::bigint) % 32 as int), 1)), '') payload_digest,
  case when page_id = top then 'response' else 'revisit' end record_type,
  case when page_id <> top then top end refers_to
from r
"""

ORACLE_SQL = {"op7_warc": OP7_SQL, "op9_decontamination": OP9_SQL, "op11_turn_repair": OP11_SQL}
