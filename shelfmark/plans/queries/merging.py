"""Version merges and keyed upserts over the events of a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.bucketed import BucketedTable, SeenLog
from shelfmark.operators.merge import MergeSpec, merge_versions, ordered_union
from shelfmark.operators.records import quality_score
from shelfmark.operators.tables import upsert_counts, upsert_merge, upsert_overwrite
from shelfmark.operators.workspace import new_dir, written
from shelfmark.plans.queries.registry import joined, query, table, utc

SPEC = MergeSpec(
    key="user_id",
    seq="event_id",
    scalars=["title", "filesize"],
    arrays=["authors", "doi"],
    provenance=["source_collection"],
    last=["aacid"],
    first=["ipfs_cid"],
)
HALF = "timestamp '2024-01-16 00:00:00'"


def versions(spark: SparkSession, folder: str, key: str = "user_id") -> DataFrame:
    """Every event is a version of the record of its user: ties in score, times out of order, empty
    values and deletions occur many times per user."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    e = table(spark, folder, "events").withColumn("k", k)
    no = F.array().cast("array<string>")
    return e.select(
        "event_id",
        "user_id",
        utc("ts").alias("ts"),
        "k",
        F.least(F.floor(F.col("value") / 10), F.lit(5)).cast("short").alias("quality_score"),
        F.when(
            kind != "view", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("k"))
        ).alias("source_timestamp"),
        F.when(kind == "signup", F.lit("")).when(
            kind != "click", F.concat_ws("-", kind, F.col("k"))
        ).alias("title"),
        F.when(kind != "purchase", F.col("event_id")).alias("filesize"),
        F.array(kind, F.concat(F.lit("k"), F.col("k"))).alias("authors"),
        F.when(kind == "error", no).otherwise(F.array(F.floor(F.col("k") / 10).cast("string"))).alias("doi"),
        F.when(kind == "view", F.lit("")).otherwise(kind).alias("source_collection"),
        F.when(F.col("k") < 60, F.concat(F.lit("a"), F.col("event_id"))).alias("aacid"),
        F.when(F.col("k") > 30, F.concat(F.lit("c"), F.col("k"))).alias("ipfs_cid"),
        (kind == "error").alias("deleted"),
        F.when((kind == "error") & (F.col("k") >= 10), F.concat(F.lit("r"), F.col("k"))).alias(
            "removed_reason"
        ),
    )


_VERSIONS = """
v0 as (select event_id, user_id, ts, event_type as kind, value, cast(props::json->>'k' as int) as k from events),
v as (
  select event_id, user_id, ts, k, least(floor(value / 10), 5)::int as score,
    case when kind <> 'view' then timestamp '2024-01-01' + to_hours(k) end as st,
    case when kind = 'signup' then '' when kind <> 'click' then kind || '-' || k end as title,
    case when kind <> 'purchase' then event_id end as filesize,
    [kind, 'k' || k] as authors,
    case when kind = 'error' then [] else [cast(floor(k / 10)::int as varchar)] end as doi,
    case when kind = 'view' then '' else kind end as coll,
    case when k < 60 then 'a' || event_id end as aacid,
    case when k > 30 then 'c' || k end as cid,
    kind = 'error' as gone, case when kind = 'error' and k >= 10 then 'r' || k end as reason
  from v0)"""


def _fold(source: str, name: str) -> str:
    """The merge of ``source`` as window SQL, in CTEs ``name`` and ``name``_w."""
    w = "over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)"
    tie = "(score = pm and st is not null and (pt is null or st > pt))"
    return f"""
{name}_w as (
  select *, max(score) {w} as pm, max(st) {w} as pt, bool_or(coalesce(title, '') <> '') {w} as has_title,
         bool_or(filesize is not null) {w} as has_size
  from {source}),
{name}_f as (
  select *, coalesce(title, '') <> '' and (not coalesce(has_title, false) or score > pm or {tie}) as take_title,
    filesize is not null and (not coalesce(has_size, false) or score > pm or {tie}) as take_size,
    coll <> '' and (pm is null or score >= pm) as take_coll,
    not gone and st is not null and (pt is null or st > pt) as clears
  from {name}_w),
{name}_c as (
  select *, max(event_id) filter (where clears) over (partition by user_id) as cleared from {name}_f),
{name} as (
  select user_id, max(score) as score, max(st) as st,
    arg_max(title, event_id) filter (where take_title) as title,
    arg_max(filesize, event_id) filter (where take_size) as filesize,
    arg_max(coll, event_id) filter (where take_coll) as coll,
    arg_max(aacid, event_id) filter (where aacid is not null) as aacid,
    arg_min(cid, event_id) filter (where cid is not null) as cid,
    coalesce(arg_max(gone, event_id) filter (where gone or clears), false) as gone,
    nullif(arg_min(coalesce(reason, '-'), event_id)
      filter (where gone and event_id > coalesce(cleared, -1)), '-') as first_reason
  from {name}_c group by user_id)"""


_SCALAR_OUT = """
select user_id, title, filesize, score as quality_score, strftime(st, '%Y-%m-%d %H:%M:%S') as at from """


def _scalar_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "user_id", "title", "filesize", "quality_score",
        F.date_format("source_timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


@query(f"with {_VERSIONS}, {_fold('v', 'm')} {_SCALAR_OUT} m")
def merge_fold_scalar(spark: SparkSession, folder: str) -> DataFrame:
    return _scalar_columns(merge_versions(versions(spark, folder), SPEC))


@query(f"with {_VERSIONS}, {_fold('v', 'm')} {_SCALAR_OUT} m")
def merge_fold_hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The same answer with almost every user on the path of hot keys."""
    return _scalar_columns(merge_versions(versions(spark, folder), SPEC, hot_rows=4))


@query(f"""with {_VERSIONS}, {_fold('v', 'm')}
select user_id, gone as deleted, case when gone then first_reason end as removed_reason from m""")
def merge_fold_tombstone(spark: SparkSession, folder: str) -> DataFrame:
    merged = merge_versions(versions(spark, folder), SPEC)
    return merged.select("user_id", "deleted", "removed_reason")


@query(f"""with {_VERSIONS}, {_fold('v', 'm')}
select user_id, gone as deleted, case when gone then first_reason end as removed_reason from m""")
def merge_tombstone_hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    merged = merge_versions(versions(spark, folder), SPEC, hot_rows=4)
    return merged.select("user_id", "deleted", "removed_reason")


@query(f"""with {_VERSIONS}, {_fold('v', 'm')}
select user_id, coll as source_collection, aacid, cid as ipfs_cid from m""")
def merge_provenance(spark: SparkSession, folder: str) -> DataFrame:
    merged = merge_versions(versions(spark, folder), SPEC)
    return merged.select("user_id", "source_collection", "aacid", "ipfs_cid")


_ARRAYS = f"""with {_VERSIONS},
e as (select user_id, event_id, 'a' as f, generate_subscripts(authors, 1) as i, unnest(authors) as x from v
      union all
      select user_id, event_id, 'd', generate_subscripts(doi, 1), unnest(doi) from v),
u as (select user_id, f, x, min([event_id, i]) as spot from e group by all)
select user_id, string_agg(x, '|' order by spot) filter (where f = 'a') as authors,
  coalesce(string_agg(x, '|' order by spot) filter (where f = 'd'), '') as doi from u group by user_id"""


@query(_ARRAYS)
def merge_fold_arrays(spark: SparkSession, folder: str) -> DataFrame:
    merged = merge_versions(versions(spark, folder), SPEC)
    return merged.select("user_id", joined("authors").alias("authors"), joined("doi").alias("doi"))


@query(_ARRAYS)
def ordered_array_union(spark: SparkSession, folder: str) -> DataFrame:
    """A3 by element, for keys of any size."""
    lists = ordered_union(versions(spark, folder), "user_id", "event_id", ["authors", "doi"])
    return lists.select("user_id", joined("authors").alias("authors"), joined("doi").alias("doi"))


@query(f"with {_VERSIONS}, {_fold('v', 'm')} {_SCALAR_OUT} m")
def upsert_merge_table(spark: SparkSession, folder: str) -> DataFrame:
    """The later half merged into the stored earlier half equals one merge of everything."""
    v = versions(spark, folder)
    early, late = v.filter(F.expr(f"ts < {HALF}")), v.filter(F.expr(f"ts >= {HALF}"))
    return _scalar_columns(upsert_merge(merge_versions(early, SPEC), late, SPEC))


@query(f"""with {_VERSIONS}, {_fold('v', 'm')}
select user_id, gone as deleted, case when gone then first_reason end as removed_reason, aacid from m""")
def merge_replay(spark: SparkSession, folder: str) -> DataFrame:
    """T5: everything that names its record arrives a second time and changes nothing."""
    base = new_dir(spark, "replay")
    records = BucketedTable(spark, f"{base}/records", "user_id", buckets=8)
    seen = SeenLog(spark, f"{base}/seen", "user_id", buckets=8)
    v = versions(spark, folder)
    for rows in (v, v.filter(F.col("aacid").isNotNull())):
        fresh = written(seen.unseen(rows), "fresh")
        records.upsert(fresh, lambda old, new: upsert_merge(old, new, SPEC))
        seen.append(fresh)
    return records.rows().select("user_id", "deleted", "removed_reason", "aacid")


@query(f"with {_VERSIONS}, {_fold('v', 'm')} {_SCALAR_OUT} m")
def upsert_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Releases by month of the events, each merged into the buckets of a stored table that its keys fall in."""
    table_ = BucketedTable(spark, new_dir(spark, "buckets"), "user_id", buckets=16)
    v = versions(spark, folder)
    for part in (F.expr(f"ts < {HALF}"), F.expr(f"ts >= {HALF} and user_id % 5 > 0"), F.expr(f"ts >= {HALF} and user_id % 5 = 0")):
        table_.upsert(v.filter(part), lambda old, new: upsert_merge(old, new, SPEC))
    return _scalar_columns(table_.rows())


@query(f"""with {_VERSIONS}, e as (select * from v where ts < {HALF} or user_id % 5 > 0), {_fold('e', 'm')} {_SCALAR_OUT} m""")
def earlier_version(spark: SparkSession, folder: str) -> DataFrame:
    """The table as it was before its last release, read after older versions are removed."""
    table_ = BucketedTable(spark, new_dir(spark, "buckets"), "user_id", buckets=16)
    v = versions(spark, folder)
    for part in (F.expr(f"ts < {HALF}"), F.expr(f"ts >= {HALF} and user_id % 5 > 0"), F.expr(f"ts >= {HALF} and user_id % 5 = 0")):
        table_.upsert(v.filter(part), lambda old, new: upsert_merge(old, new, SPEC))
    table_.expire(keep=2)
    return _scalar_columns(table_.rows(table_.version() - 1))


@query(f"""with {_VERSIONS}
select user_id, count(distinct aacid) as remembered, min(aacid) as least, max(aacid) as most,
  count(*) filter (where k % 2 = 1) as fresh
from v where aacid is not null group by user_id""")
def seen_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """What the log of seen records holds after overlapping releases whose deltas were joined and whose old files are gone,
    and how many records it would let through had it seen the even ones only."""
    base = new_dir(spark, "log")
    seen, even = (SeenLog(spark, f"{base}/{name}", "user_id", buckets=8) for name in ("seen", "even"))
    v = versions(spark, folder)
    for part in (F.expr(f"ts < {HALF}"), F.col("k") % 2 == 0, F.lit(True)):
        seen.append(v.filter(part))
    seen.compact()
    seen.expire()
    for part in (F.col("k") % 4 == 0, F.col("k") % 2 == 0):
        even.append(even.unseen(v.filter(part)))
    even.compact()
    held = seen.pairs().groupBy("user_id").agg(
        F.count("*").alias("remembered"), F.min("aacid").alias("least"), F.max("aacid").alias("most")
    )
    fresh = even.unseen(v.filter(F.col("aacid").isNotNull())).groupBy("user_id").agg(F.count("*").alias("fresh"))
    return held.join(fresh, "user_id", "left").fillna(0, ["fresh"])


@query(f"""with {_VERSIONS},
old_v as (select * from v where ts < {HALF}), new_v as (select * from v where ts >= {HALF}),
{_fold('old_v', 'o')}, {_fold('new_v', 'n')}
select coalesce(n.user_id, o.user_id) as user_id,
  case when n.user_id is not null then n.title else o.title end as title,
  case when n.user_id is not null then n.coll else o.coll end as source_collection,
  coalesce(n.cid, o.cid) as ipfs_cid, greatest(n.score, o.score) as quality_score,
  case when n.user_id is not null then n.gone else o.gone end as deleted,
  strftime(coalesce(n.st, o.st), '%Y-%m-%d %H:%M:%S') as at
from n full join o on n.user_id = o.user_id""")
def upsert_overwrite_table(spark: SparkSession, folder: str) -> DataFrame:
    """S6/J2."""
    v = versions(spark, folder)
    old = merge_versions(v.filter(F.expr(f"ts < {HALF}")), SPEC)
    new = merge_versions(v.filter(F.expr(f"ts >= {HALF}")), SPEC)
    rows = upsert_overwrite(old, new, key="user_id")
    return rows.select(
        "user_id", "title", "source_collection", "ipfs_cid", "quality_score", "deleted",
        F.date_format("source_timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


@query(f"""with keys as (
  select distinct user_id * 1000 + cast(props::json->>'k' as int) as k, ts < {HALF} as early from events)
select count(*) filter (where not exists (select 1 from keys e where e.early and e.k = l.k)) as inserted,
       count(*) filter (where exists (select 1 from keys e where e.early and e.k = l.k)) as updated
from keys l where not l.early""")
def upsert_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """J1."""
    e = table(spark, folder, "events").select(
        (F.col("user_id") * 1000 + F.get_json_object("props", "$.k").cast("int")).alias("md5"),
        utc("ts").alias("ts"),
    )
    early = e.filter(F.expr(f"ts < {HALF}")).select("md5").distinct()
    return upsert_counts(early, e.filter(F.expr(f"ts >= {HALF}")))


@query("""
select p_partkey, (case when p_name <> '' then 10 else 0 end) + (case when p_size > 10 then 8 else 0 end)
  + (case when p_type <> 'ECONOMY' then 3 else 0 end) + 2
  + (case when p_size > 30 then 6 else 0 end) + (case when p_size < 5 or p_partkey = 0 then 0 else 1 end)
  + (case when p_size between 20 and 40 then 1 else 0 end) as quality_score
from part""")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A2: parts as records with missing fields."""
    size = F.col("p_size")
    none = F.array().cast("array<string>")
    records = table(spark, folder, "part").select(
        "p_partkey",
        F.col("p_name").alias("title"),
        F.when(size > 10, F.array("p_brand")).otherwise(none).alias("authors"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("")).otherwise(F.col("p_type")).alias("publisher"),
        F.lit(None).cast("short").alias("publication_year"),
        F.array(F.lit("eng")).alias("languages"),
        F.lit(None).cast("string").alias("extension"),
        F.when(size < 5, F.lit(0)).otherwise(F.col("p_partkey")).cast("long").alias("filesize"),
        F.when(size > 30, F.array("p_brand")).otherwise(none).alias("isbn13"),
        *[none.alias(n) for n in ("isbn10", "doi", "oclc", "openlibrary_ids")],
        F.lit("").alias("series_name"),
        F.when(size.between(20, 40), F.lit(0)).cast("short").alias("series_position"),
        F.lit(None).cast("string").alias("edition"),
    )
    return records.select("p_partkey", quality_score().alias("quality_score"))
