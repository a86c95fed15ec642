"""The numbered queries, each a thin digest of what its operator returns for a whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    bit_planes,
    bpe,
    chat,
    equal_average,
    exact_dedup,
    fixed_blocks,
    html_text,
    order_minhash,
    packing,
    pii,
    quality,
    simhash,
    token_counts,
)
from shelfmark.llm.vector_sql import CLUSTERS_SQL, CODES_SQL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    """Registers the function under its name, with the same question as SQL where SQL can say it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add(fn) if fn else add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op1_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.compare_with_next(table(spark, folder, "documents"))


@query(
    sql="""
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
           from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept,
  sha256(t) as text_sha256
from t window g as (partition by t)"""
)
def op8_grace_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query
def op4_golay_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op5_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_weak_supervision_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


@query
def op9_block_tree_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


# A block has its role and two marks of 24 characters with their line ends, a further text of it a mark of 11; & gets one
# character longer.
@query(
    sql="""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s as (
  select *, row_number() over w as n, lag(role) over w as before from t
  window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(replace(text, '&', '&a')) + case when before is not distinct from role then 11
      else 24 + length(replace(replace(role, '&', '&a'), chr(10), '&n')) end)::bigint as formatted_chars
from s group by conv_id"""
)
def op6_relational_chat(spark: SparkSession, folder: str) -> DataFrame:
    marks = "<|im_end|><|im_start|>assistant ok"
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(marks).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    return chat.digests(chat.formatted(chat.turns_of(rows)))


@query(
    sql=r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
n as (select doc_id, words, unnest(range(1, len(words) + 1)) as place from w),
s as (select doc_id, place, words[place] as word,
        case when place + 19 <= len(words) then array_to_string(words[place:place + 19], ' ') end as run from n),
d as (select doc_id, place, word,
        run is not null and row_number() over (partition by run order by doc_id, place) > 1 as again from s),
g as (select doc_id, place, word,
        max(again) over (partition by doc_id order by place rows between 19 preceding and current row) as gone from d),
k as (select doc_id, count(*) filter (where gone) as n_removed,
        string_agg(word, ' ' order by place) filter (where not gone) as kept from g group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (doc_id)"""
)
def op11_fixed_block_anchors(spark: SparkSession, folder: str) -> DataFrame:
    rows = fixed_blocks.without_repeats(table(spark, folder, "documents"))
    kept = F.sha2(F.col("text").cast("binary"), 256)
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", kept.alias("kept_sha256"))


@query(sql=CODES_SQL)
def op12_equal_average_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows, codebooks = equal_average.compressed(table(spark, folder, "embeddings"))
    entries = F.sha2(F.lit(equal_average.joined(codebooks)).cast("binary"), 256)
    code = F.lower(F.hex("code"))
    return rows.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", entries.alias("codebooks_sha256"))


@query(sql=CLUSTERS_SQL)
def op13_bit_plane_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return bit_planes.digests(*bit_planes.clustered(table(spark, folder, "embeddings")))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
