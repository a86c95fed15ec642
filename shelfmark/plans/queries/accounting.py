"""Discards, ledger and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import discards, ledger, tables
from shelfmark.operators.workspace import new_dir
from shelfmark.plans import reports
from shelfmark.plans.queries.registry import joined, query, table, utc
from shelfmark.streaming.buckets import performance_buckets

# ---- discards -------------------------------------------------------------------------------

_FILTERS = """
defaults as (select source as subcollection from documents group by source having max(n_chars) > 15000),
overrides as (
  select source as subcollection, sum(quality) > sum(1 - quality) as blocked
  from documents join labels using (doc_id) where toxic = 1 group by source),
filters as (
  select coalesce(d.subcollection, o.subcollection) as subcollection, coalesce(o.blocked, true) as blocked,
         d.subcollection is not null as is_default, o.subcollection is not null as has_override
  from defaults d full join overrides o on d.subcollection = o.subcollection)"""


def _filters(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    defaults = docs.groupBy(F.col("source").alias("subcollection")).agg(F.max("n_chars").alias("m"))
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id")
    overrides = toxic.groupBy(F.col("source").alias("subcollection")).agg(
        (F.sum("quality") > F.sum(1 - F.col("quality"))).alias("blocked")
    )
    return defaults.filter("m > 15000").select("subcollection"), overrides


@query(f"with {_FILTERS} select * from filters")
def effective_filters(spark: SparkSession, folder: str) -> DataFrame:
    return discards.effective_filters(*_filters(spark, folder))


_DISCARDED = f"""{_FILTERS},
marked as (
  select doc_id, text, source, lang, case when blocked then 'blocked_subcollection:' || source
    when n_chars < 300 then 'missing_title_or_author' end as reason
  from documents left join filters on source = subcollection)"""


def _discarded(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    marked = discards.with_block_reason(docs, "source", discards.effective_filters(*_filters(spark, folder)))
    short = F.when(F.col("n_chars") < 300, F.lit("missing_title_or_author"))
    return marked.withColumn("discard_reason", F.coalesce("discard_reason", short)).filter(
        F.col("discard_reason").isNotNull()
    )


@query(f"""with {_DISCARDED}
select reason as discard_reason, count(*) as n from marked where reason is not null group by 1""")
def discard_counts(spark: SparkSession, folder: str) -> DataFrame:
    return discards.discard_counts(_discarded(spark, folder))


@query(f"""with {_DISCARDED},
firsts as (
  select reason, md5(text) as md5, lang, nullif(substr(text, 1, 160), '') as title, source,
         min(doc_id) as first_doc
  from marked where reason is not null group by all),
placed as (select *, row_number() over (partition by reason order by first_doc) as place from firsts)
select reason as discard_reason, place, md5, lang as source_record_id, title, source as authors
from placed where place <= 3""")
def discard_samples(spark: SparkSession, folder: str) -> DataFrame:
    rows = _discarded(spark, folder).select(
        "discard_reason",
        F.col("doc_id").alias("seq"),
        F.md5(F.col("text").cast("binary")).alias("md5"),
        F.col("lang").alias("source_record_id"),
        F.lit(None).cast("string").alias("aacid"),
        F.col("text").alias("title"),
        F.array("source").alias("authors"),
    )
    samples = discards.discard_samples(rows)
    return samples.select(
        "discard_reason", "place", "md5", "source_record_id", "title", joined("authors").alias("authors")
    )


@query("""
with dates as (
  select lang as release_id, count(*) as n from documents group by lang),
kinds as (
  select source as reason, lang, md5(text) as sample, min(doc_id) as doc_id from documents group by all),
numbered as (
  select *, row_number() over (partition by reason, lang order by doc_id) as place from kinds),
firsts as (
  select reason, sample, min([-n, hash_id, place]) as spot
  from (select k.*, d.n, case lang when 'de' then 1 when 'en' then 2 when 'es' then 3 else 4 end as hash_id
        from numbered k join dates d on k.lang = d.release_id) where place <= 3 group by all),
placed as (select *, row_number() over (partition by reason order by spot) as place from firsts)
select reason as discard_reason, sample, place from placed where place <= 3""")
def samples_over_releases(spark: SparkSession, folder: str) -> DataFrame:
    """A6 over releases: a language stands for a release, the larger one counts as newer."""
    docs = table(spark, folder, "documents").withColumn(
        "sample", F.md5(F.col("text").cast("binary"))
    )
    ids = F.create_map(*[F.lit(x) for p in (("de", -1), ("en", -2), ("es", -3), ("fr", -4)) for x in p])
    sizes = docs.groupBy("lang").agg(F.count("*").alias("size"))
    first3 = discards.first_distinct(
        docs.select(F.concat_ws(" ", "source", "lang").alias("g"), "doc_id", "source", "lang", "sample"),
        "g", "doc_id", ["source", "lang", "sample"],
    )
    rows = first3.join(sizes, "lang").select(
        F.try_element_at(ids, "lang").alias("release_id"),
        F.timestamp_seconds("size").alias("discovered_at"),
        F.col("source").alias("discard_reason"), "place", "sample",
    )
    return discards.samples_over_releases(rows).select("discard_reason", "sample", "place")


# ---- ledger ---------------------------------------------------------------------------------

_LEDGER = """
ledger as (
  select o_orderkey as release_id, 'c' || o_custkey as collection, 'r' || lpad(o_orderkey::varchar, 12, '0')
    as release_identifier,
    case o_orderpriority when '1-URGENT' then 'importing' when '2-HIGH' then 'failed' when '5-LOW' then 'discovered'
      else 'completed' end as status,
    o_orderdate as discovered_at,
    case when o_orderpriority <> '5-LOW' then o_orderdate + interval 1 day end as started_at,
    case when o_orderstatus <> 'P' and o_orderpriority <> '5-LOW' then o_orderdate + interval 30 hour end
      as import_started_at,
    case when o_orderpriority like '3%' or o_orderpriority like '4%'
      then o_orderdate + interval 3 day + to_seconds(o_orderkey) end as completed_at,
    case when o_orderstatus = 'F' then floor(o_totalprice)::bigint end as records_discarded,
    case when o_orderstatus = 'O' then floor(o_totalprice / 100)::bigint end as records_failed
  from orders)"""


def releases(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a release ledger: the customer is the collection, the priority the state."""
    p, at = F.col("o_orderpriority"), utc("o_orderdate")
    late = p == "5-LOW"
    status = (
        F.when(p == "1-URGENT", "importing").when(p == "2-HIGH", "failed").when(late, "discovered")
        .otherwise("completed")
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("release_id"),
        F.concat(F.lit("c"), "o_custkey").alias("collection"),
        F.concat(F.lit("r"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("release_identifier"),
        status.alias("status"),
        at.alias("discovered_at"),
        F.when(~late, at + F.expr("interval 1 day")).alias("started_at"),
        F.when((F.col("o_orderstatus") != "P") & ~late, at + F.expr("interval 30 hours")).alias(
            "import_started_at"
        ),
        F.when(
            p.substr(1, 1).isin("3", "4"),
            at + F.expr("interval 3 days") + F.make_dt_interval(secs=F.col("o_orderkey")),
        ).alias("completed_at"),
        F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice")).alias("records_discarded"),
        F.when(F.col("o_orderstatus") == "O", F.floor(F.col("o_totalprice") / 100)).alias("records_failed"),
    )


@query(f"""with {_LEDGER}
select count(*) as releases, coalesce(sum(records_discarded), 0)::bigint as discarded,
       coalesce(sum(records_failed), 0)::bigint as failed from ledger""")
def ledger_totals(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.ledger_totals(releases(spark, folder))


@query(f"""with {_LEDGER}
select strftime(max(completed_at) filter (where status = 'completed'), '%Y-%m-%d %H:%M:%S') as last_success
from ledger""")
def last_success(spark: SparkSession, folder: str) -> DataFrame:
    row = ledger.last_success(releases(spark, folder))
    return row.select(F.date_format("last_success", "yyyy-MM-dd HH:mm:ss").alias("last_success"))


_LATEST = """
latest as (
  select * from ledger qualify row_number() over (
    partition by collection order by discovered_at desc, release_identifier desc) = 1)"""


@query(f"with {_LEDGER}, {_LATEST} select collection, release_identifier, status from latest")
def latest_per_collection(spark: SparkSession, folder: str) -> DataFrame:
    rows = ledger.latest_per_collection(releases(spark, folder))
    return rows.select("collection", "release_identifier", "status")


@query(f"""with {_LEDGER}, {_LATEST}
select collection, release_identifier from latest where status <> 'completed'""")
def pending_releases(spark: SparkSession, folder: str) -> DataFrame:
    rows = releases(spark, folder)
    return ledger.pending(ledger.latest_per_collection(rows), rows).select("collection", "release_identifier")


_IMPORTED = """
imported as (
  select collection, arg_max(release_identifier, [epoch_us(completed_at)::varchar, release_identifier])
    as last_imported_identifier
  from ledger where status = 'completed' group by collection)"""


@query(f"with {_LEDGER}, {_IMPORTED} select * from imported")
def last_imported(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.last_imported(releases(spark, folder))


@query(f"""with {_LEDGER}, {_LATEST}, {_IMPORTED}
select 'c' || c_custkey as collection, coalesce(status, 'not_discovered') as status, release_identifier,
       last_imported_identifier
from customer left join latest l on l.collection = 'c' || c_custkey
left join imported i on i.collection = 'c' || c_custkey""")
def collection_overview(spark: SparkSession, folder: str) -> DataFrame:
    rows = releases(spark, folder)
    names = table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("collection"))
    latest = ledger.latest_per_collection(rows).select("collection", "status", "release_identifier")
    return ledger.collection_overview(names, latest, ledger.last_imported(rows))


@query("""select 'c' || p_partkey as collection from part
except select 'c' || o_custkey from orders""")
def collections_not_found(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select(F.concat(F.lit("c"), "p_partkey").alias("collection"))
    return ledger.not_found(names, releases(spark, folder))


@query(f"""with {_LEDGER}
select release_id, case when started_at is null and import_started_at is null then null
    when status = 'importing' then epoch(timestamp '2030-01-01')::bigint
      - epoch(coalesce(import_started_at, started_at))::bigint
    when completed_at is not null then epoch(completed_at)::bigint
      - epoch(coalesce(import_started_at, started_at))::bigint end as import_seconds,
  import_started_at is null and started_at is not null as timing_estimated,
  strftime(started_at, '%Y-%m-%d %H:%M:%S') as started,
  strftime(import_started_at, '%Y-%m-%d %H:%M:%S') as import_started,
  strftime(completed_at, '%Y-%m-%d %H:%M:%S') as completed
from ledger""")
def release_durations(spark: SparkSession, folder: str) -> DataFrame:
    rows = ledger.release_summary(releases(spark, folder), F.lit("2030-01-01").cast("timestamp"))
    return rows.select(
        "release_id", "import_seconds", "timing_estimated", "started", "import_started", "completed"
    )


@query(f"""with {_LEDGER}
select release_identifier, status from ledger order by discovered_at desc, release_identifier limit 20""")
def recent_releases(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.recent(releases(spark, folder), 20).select("release_identifier", "status")


@query("""
select l_orderkey as release_id, count(*) as seen, sum(l_quantity)::bigint as inserted,
  coalesce(sum(l_quantity) filter (where l_returnflag = 'A'), 0)::bigint as updated,
  sum(l_linenumber)::bigint as skipped,
  coalesce(sum(l_linenumber) filter (where l_linestatus = 'F'), 0)::bigint as discarded,
  count(*) filter (where l_returnflag = 'R') as failed
from lineitem group by l_orderkey""")
def running_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as counter deltas of their order."""
    qty, line = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    deltas = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("release_id"), F.lit(1).cast("long").alias("seen"), qty.alias("inserted"),
        F.when(F.col("l_returnflag") == "A", qty).alias("updated"), line.alias("skipped"),
        F.when(F.col("l_linestatus") == "F", line).alias("discarded"),
        F.when(F.col("l_returnflag") == "R", F.lit(1)).cast("long").alias("failed"),
    )
    return ledger.sum_deltas(deltas)


def _reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Counter maps per order: return flag and line state to number of lines."""
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("release_id"),
        F.concat_ws(":", "l_returnflag", "l_linestatus").alias("reason"),
        F.lit(1).cast("long").alias("n"),
    )
    return ledger.reason_map(items, "release_id")


@query("""
select reason, count(*) as n from (
  select l_returnflag || ':' || l_linestatus as reason from lineitem) group by reason""")
def reason_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Counter maps taken apart again and summed."""
    maps = _reasons(spark, folder)
    return ledger.reason_totals(ledger.reason_rows(maps, ["release_id"]))


@query("""
with c as (select l_orderkey, l_returnflag || ':' || l_linestatus as reason, count(*) as n
           from lineitem group by all)
select l_orderkey as release_id, string_agg(reason || '=' || n, ',' order by reason) as reasons
from c group by l_orderkey""")
def reason_maps(spark: SparkSession, folder: str) -> DataFrame:
    entries = F.map_entries("discard_reasons")
    text = F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"]))
    return _reasons(spark, folder).select("release_id", joined(text, ",").alias("reasons"))


@query("""
select user_id, event_type, arg_max(value, event_id) as value, max(event_id) as event_id
from events group by user_id, event_type""")
def last_write_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """L3/L4."""
    e = table(spark, folder, "events").select("user_id", "event_type", "ts", "value", "event_id")
    rows = ledger.last_write(e, ["user_id", "event_type"], "ts")
    return rows.select("user_id", "event_type", "value", "event_id")


@query(f"""with {_LEDGER},
known as (select collection, release_identifier, case when status = 'failed' then null else status end as btih
          from ledger where discovered_at < timestamp '2000-01-01'),
found as (select collection, release_identifier, case when status <> 'discovered' then 'new' end as btih from ledger)
select collection, release_identifier, coalesce(f.btih, k.btih) as btih, k.collection is null as is_new
from known k full join found f using (collection, release_identifier)""")
def release_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """L2."""
    rows = releases(spark, folder)
    known = rows.filter(F.col("discovered_at") < "2000-01-01").select(
        "collection", "release_identifier", F.when(F.col("status") != "failed", F.col("status")).alias("btih")
    )
    found = rows.select(
        "collection", "release_identifier", F.when(F.col("status") != "discovered", "new").alias("btih")
    )
    return ledger.upsert_releases(known, found)


@query(f"""with {_LEDGER}, payloads as (
  select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'c0' else 'c' || o_custkey end as collection,
    'r' || lpad(l_orderkey::varchar, 12, '0') as release_identifier
  from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, collection, release_id
from payloads left join ledger using (collection, release_identifier)""")
def payload_releases(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as payloads of their order; returned ones name a collection of their own."""
    items = table(spark, folder, "lineitem").join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    payloads = items.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.lit("c0")).otherwise(F.concat(F.lit("c"), "o_custkey")).alias(
            "collection"
        ),
        F.concat(F.lit("r"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("release_identifier"),
    )
    rows = ledger.attach_release(payloads, releases(spark, folder))
    return rows.select("l_orderkey", "l_linenumber", "collection", "release_id")


# ---- reports --------------------------------------------------------------------------------


@query("""
with names as (
  select distinct source as name from documents where lang = 'es'
  union select 'absent_' || source from documents),
counts as (select source, count(*) as n from documents group by source)
select name as source, coalesce(n, 0) as n, (select count(*) from documents) as scanned
from names left join counts on name = source""")
def fixed_name_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A12."""
    docs = table(spark, folder, "documents")
    names = docs.filter("lang = 'es'").select("source").union(
        docs.select(F.concat(F.lit("absent_"), "source"))
    )
    return reports.fixed_name_counts(docs, names, "source")


_IMPACT = f"""with {_FILTERS},
dates as (select lang, timestamp '2024-01-01' + to_days(count(*)::int) as discovered_at from documents group by lang),
counted as (select lang, source, count(*) as n from documents group by all),
recomputed as (select lang, source, count(*) as n from documents join labels using (doc_id)
               where toxic = 1 group by all),
filtered as (
  select lang, source, coalesce(r.n, c.n) as n from counted c left join recomputed r using (lang, source)),
seen as (
  select source, sum(n)::bigint as total,
         arg_max(n, [epoch_us(discovered_at)::varchar, lang]) as latest
  from filtered join dates using (lang) group by source)"""


@query(f"""{_IMPACT}
select coalesce(f.subcollection, s.source) as subcollection, coalesce(blocked, false) as blocked,
  coalesce(is_default, false) as is_default, coalesce(has_override, false) as has_override, latest,
  coalesce(total, 0) as total,
  case when latest is null then null when coalesce(blocked, false) then latest * 512 else 0 end as extra_bytes
from filters f full join seen s on f.subcollection = s.source""")
def filter_impact(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as filters, languages as releases; labelled documents as reanalysis."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    dates = docs.groupBy("lang").agg(
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.count("*").cast("int"))).alias(
            "discovered_at"
        )
    )
    counted = docs.groupBy("lang", F.concat(F.lit(reports.BLOCKED), "source").alias("reason")).agg(
        F.count("*").alias("n")
    )
    releases = dates.select(
        F.col("lang").alias("release_id"), F.col("lang").alias("release_identifier"), "discovered_at"
    )
    counted = ledger.with_releases(counted.withColumnRenamed("lang", "release_id"), releases)
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id")
    recomputed = toxic.groupBy("lang", F.col("source").alias("subcollection")).agg(F.count("*").alias("n"))
    recomputed = ledger.with_releases(recomputed.withColumnRenamed("lang", "release_id"), releases)
    filtered = reports.recomputed_replaces(reports.counted_filters(counted), recomputed)
    return reports.filter_impact(*_filters(spark, folder), filtered, 512.0)


@query("""
with c as (select o_orderstatus as status, count(*) as n from orders group by 1),
names as (select status from c union select r_name from region),
t as (select count(*) as total from orders)
select names.status, coalesce(n, 0) as n, coalesce(n, 0) / total as share,
       round_even(1000000.0::double * (coalesce(n, 0) / total), 0)::bigint as bytes
from names left join c using (status), t""")
def collection_shares(spark: SparkSession, folder: str) -> DataFrame:
    """A10/U3."""
    orders = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("status"))
    names = table(spark, folder, "region").select(F.col("r_name").alias("status"))
    return reports.shares(orders, names, "status", 1_000_000)


@query("select o_orderstatus as status, count(*) as n from orders group by 1")
def collection_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A7."""
    orders = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("status"))
    return reports.counts_by(orders, "status")


@query("""
select coalesce(nullif(p_name, 'red widget'), '-') as format, count(*) as n from part where p_size <= 45
group by 1 order by n desc, format limit 10""")
def top_formats(spark: SparkSession, folder: str) -> DataFrame:
    """A8."""
    records = table(spark, folder, "part").select(
        F.nullif("p_name", F.lit("red widget")).alias("extension"), (F.col("p_size") > 45).alias("deleted")
    )
    return reports.top_formats(records)


@query("""
select count(*) as records, count(*) filter (where p_size > 45) as tombstones,
       count(*) filter (where p_type <> 'ECONOMY') as with_work_key from part""")
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    """A9."""
    records = table(spark, folder, "part").select(
        (F.col("p_size") > 45).alias("deleted"), F.nullif("p_type", F.lit("ECONOMY")).alias("work_key")
    )
    return reports.table_profile(records)


@query("""
with s as (select count(*) as records, sum(strlen(text) + strlen(lang) + strlen(source))::bigint as bytes
           from documents)
select records, bytes, bytes / records as bytes_per_row, bytes / records * 30000000 as projected_bytes from s""")
def row_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """A21."""
    return reports.bytes_per_row(table(spark, folder, "documents"), ["text", "lang", "source"])


_BUCKETS = """
samples as (select event_type as release_id, ts, event_id as r,
                   event_id * 100 + cast(props::json->>'k' as int) as b from events),
buckets as (
  select release_id, time_bucket(interval 5 minutes, ts) as bucket_start, min(ts) as first_at, max(ts) as last_at,
    arg_min(r, ts) as first_records, arg_max(r, ts) as last_records, arg_min(b, ts) as first_bytes,
    arg_max(b, ts) as last_bytes
  from samples group by 1, 2)"""


def samples(events: DataFrame) -> DataFrame:
    """Events as throughput samples: the type is the release, counters grow with the event."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_type").alias("release_id"), utc("ts").alias("ts"), F.col("event_id").alias("records_seen"),
        (F.col("event_id") * 100 + k).alias("bytes"),
    )


def bucket_columns(rows: DataFrame) -> DataFrame:
    as_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return rows.select(
        "release_id", as_text("bucket_start"), as_text("first_at"), as_text("last_at"),
        "first_records", "last_records", "first_bytes", "last_bytes",
    )


BUCKET_SQL = f"""with {_BUCKETS}
select release_id, strftime(bucket_start, '%Y-%m-%d %H:%M:%S.%f') as bucket_start,
  strftime(first_at, '%Y-%m-%d %H:%M:%S.%f') as first_at, strftime(last_at, '%Y-%m-%d %H:%M:%S.%f') as last_at,
  first_records, last_records, first_bytes, last_bytes from buckets"""


@query(BUCKET_SQL)
def five_minute_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """T2 as a batch."""
    return bucket_columns(performance_buckets(samples(table(spark, folder, "events"))))


@query(f"""with {_BUCKETS}, span as (
  select *, (epoch_us(last_at) - epoch_us(first_at)) / 1e6 as seconds from buckets
  where bucket_start >= (select max(ts) from events) - interval 12 hour)
select release_id, 'k' || release_id as collection, strftime(bucket_start, '%Y-%m-%d %H:%M:%S') as bucket_start,
  round(seconds, 6) as sample_seconds, round(greatest((last_records - first_records) / seconds, 0), 6)
    as records_per_second, round(greatest((last_bytes - first_bytes) / seconds, 0), 6) as bytes_per_second
from span where seconds > 0""")
def bucket_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The window ends at the newest event."""
    events = table(spark, folder, "events")
    buckets = performance_buckets(samples(events))
    named = events.select(F.col("event_type").alias("release_id")).distinct().withColumn(
        "collection", F.concat(F.lit("k"), "release_id")
    )
    newest = events.agg(F.max(utc("ts"))).scalar()
    rates = reports.bucket_rates(buckets, named, newest)
    return rates.select(
        "release_id", "collection", F.date_format("bucket_start", "yyyy-MM-dd HH:mm:ss").alias("bucket_start"),
        *[F.round(c, 6).alias(c) for c in ("sample_seconds", "records_per_second", "bytes_per_second")],
    )


@query("""
select doc_id, source, lang from documents where source in ('src1', 'src3', 'src5', 'src7')""")
def purge_kept(spark: SparkSession, folder: str) -> DataFrame:
    """F14."""
    docs = table(spark, folder, "documents")
    return tables.kept_rows(docs, ["src1", "src3", "src5", "src7"], "source").select("doc_id", "source", "lang")


@query("""
select source, count(*) as n from documents where source not in ('src1', 'src3', 'src5', 'src7') group by 1""")
def purge_strays(spark: SparkSession, folder: str) -> DataFrame:
    """What a purge has to remove."""
    return tables.strays(table(spark, folder, "documents"), ["src1", "src3", "src5", "src7"], "source")


@query("""
select doc_id, case when source <> 'src9' then source end as source,
  case when source in ('src1', 'src3', 'src5', 'src7', 'src9') then 'kept' else 'backup' end as place from documents""")
def purge_backup(spark: SparkSession, folder: str) -> DataFrame:
    """A purge with its backup; documents of one source are of no collection and stay."""
    docs = table(spark, folder, "documents").select("doc_id", F.nullif("source", F.lit("src9")).alias("source"))
    backup, target = new_dir(spark, "backup"), new_dir(spark, "kept")
    tables.purge({"documents": (docs, "source")}, ["src1", "src3", "src5", "src7"], backup, target)
    places = [spark.read.parquet(f"{d}/documents").withColumn("place", F.lit(n)) for d, n in ((target, "kept"), (backup, "backup"))]
    return places[0].unionByName(places[1])


@query("select 'lineitem' as name, count(*) as n from lineitem union all select 'documents', count(*) from documents")
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of whole tables within a time."""
    names = ["lineitem", "documents"]
    counts = [(n, reports.counted_within(table(spark, folder, n), 600).rows) for n in names]
    return spark.createDataFrame(counts, "name string, n long")
