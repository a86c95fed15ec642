"""Adapters and streaming imports over dump lines written from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.discards import discard_counts, error_samples, import_counters
from shelfmark.operators.gate import gate_outcomes
from shelfmark.operators.records import with_derived
from shelfmark.operators.tables import upsert_merge
from shelfmark.operators.workspace import new_dir, written
from shelfmark.plans.imports import import_release
from shelfmark.plans.queries.accounting import BUCKET_SQL, bucket_columns, samples
from shelfmark.plans.queries.registry import joined, query, spread, table, utc
from shelfmark.sources import adapters
from shelfmark.sources.adapters import adapt, adapt_mixed
from shelfmark.sources.jsonl import read_lines
from shelfmark.sources.salvage import breaks, payloads, read_frames, salvaged
from shelfmark.streaming.buckets import distinct_records, first_of_bursts, performance_buckets
from shelfmark.streaming.imports import fold_staged, stage_stream, staged_counters


def _md5(c: str | Column) -> Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def _line(aacid: Column, metadata: Column) -> Column:
    return F.to_json(F.struct(aacid.alias("aacid"), metadata.alias("metadata"))).alias("line")


def zlib3_lines(spark: SparkSession, folder: str) -> DataFrame:
    d = spread(table(spark, folder, "documents")).join(table(spark, folder, "labels"), "doc_id", "left")
    short = F.col("n_chars") < 200
    meta = F.struct(
        F.when(F.col("lang") != "es", F.upper(_md5("text"))).otherwise(F.col("source")).alias("md5_reported"),
        F.col("doc_id").alias("zlibrary_id"),
        F.array(F.lit(" "), F.concat(F.lit(" "), "text", F.lit(" "))).alias("title"),
        F.concat("source", F.lit("; "), "lang", F.lit(" and "), "source").alias("author"),
        F.when(~short, F.concat(F.lit("["), "lang", F.lit("] press"))).alias("publisher"),
        F.when(~short, F.concat("lang", F.lit("-XX"))).alias("language"),
        F.lit("Vol. x").alias("volume"),
        F.lit("ePub ").alias("extension"),
        F.when(~short, F.col("n_chars")).alias("filesize_reported"),
        F.array(F.lit("B0SHELFMRK"), F.lit("1-234-56789-X"), F.lit("9781234567897")).alias("isbns"),
        F.when(F.col("toxic") == 1, F.lit(1)).alias("removed"),
        F.when(F.col("toxic") == 1, F.col("source")).alias("removalReason"),
        F.when(
            short,
            F.struct(
                F.struct(
                    F.col("lang").alias("language"), F.lit("in 1999").alias("year"),
                    F.lit("77").alias("filesize"), F.col("source").alias("ipfs_cid"),
                ).alias("response")
            ),
        ).alias("annabookinfo"),
    )
    aacid = F.concat(F.lit("aacid__zlib3_records__20240102T030405Z__"), "doc_id", F.lit("__x"))
    return d.select(F.col("doc_id").alias("seq"), _line(aacid, meta))


_CODES = "(case lang when 'en' then 'eng' when 'de' then 'deu' when 'fr' then 'fra' when 'es' then 'spa' end)"


@query(f"""
select doc_id as seq, case when lang = 'es' then 'skipped' else 'kept' end as outcome,
  case when lang <> 'es' then md5(text) end as md5, case when lang <> 'es' then trim(text, ' \n\t\r') end as title,
  case when lang <> 'es' then source || '|' || lang || '|' || source else '' end as authors,
  case when lang <> 'es' and n_chars >= 200 then '[' || lang || '] press' end as publisher,
  case when lang <> 'es' then {_CODES} else '' end as languages,
  case when lang <> 'es' then 'epub' end as extension,
  case when lang <> 'es' then case when n_chars >= 200 then n_chars else 77 end end as filesize,
  case when lang <> 'es' and n_chars < 200 then 1999 end as year,
  case when lang <> 'es' then '9781234567897' else '' end as isbns,
  coalesce(toxic = 1, false) and lang <> 'es' as deleted,
  case when toxic = 1 and lang <> 'es' then source end as removed_reason,
  case when lang <> 'es' and n_chars < 200 then source end as ipfs_cid,
  case when lang <> 'es' then '2024-01-02 03:04:05' end as at
from documents left join labels using (doc_id)""")
def adapter_zlib3(spark: SparkSession, folder: str) -> DataFrame:
    """P1."""
    rows = adapt(zlib3_lines(spark, folder), adapters.ZLIB3)
    return rows.select(
        "seq", "outcome", "md5", "title", joined("authors").alias("authors"), "publisher",
        joined("languages").alias("languages"), "extension", "filesize",
        F.col("publication_year").alias("year"), joined("isbn13").alias("isbns"), "deleted",
        "removed_reason", "ipfs_cid", F.date_format("source_timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


def ia2_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty turns of a conversation are an item, so that no item grows with the data; the turns are
    its files, equal turns are equal files."""
    turns = table(spark, folder, "conversations").withColumn("part", F.floor(F.col("turn") / 50))
    name = F.concat(F.lit("dir.x/"), "role", F.lit("."), "turn", F.lit(".TXT"))
    files = F.transform(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "turn", name.alias("name"),
                    F.when(F.col("role") == "user", F.length("text").cast("string")).otherwise("n/a").alias("size"),
                    _md5(F.col("text")).alias("md5"),
                )
            )
        ),
        lambda f: F.struct(f["name"].alias("name"), f["size"].alias("size"), f["md5"].alias("md5")),
    )
    items = turns.groupBy("conv_id", "part").agg(files.alias("files"), F.count("*").alias("n"))
    audio = F.col("n") < 4
    meta = F.struct(
        F.concat(F.lit("item"), "conv_id").alias("ia_id"),
        F.struct(
            F.struct(
                F.array(F.lit(""), F.concat(F.lit("Item "), "conv_id")).alias("title"),
                F.when(audio, F.array(F.lit("Audio"))).alias("mediatype"),
                F.lit("West, A; Doe, B").alias("creator"),
                F.array(F.lit("Doe, B"), F.lit("C & D")).alias("associated-names"),
                F.concat(F.lit("c"), F.col("conv_id") + 1000).alias("date"),
                F.array(F.lit("OL1M"), F.lit("OL1X")).alias("openlibrary_edition"),
                F.lit("OL22W").alias("openlibrary_work"),
                F.array(F.lit("12"), F.lit("x1")).alias("oclc-id"),
                F.array(F.lit("eng")).alias("language"),
            ).alias("metadata"),
            F.col("files").alias("aa_shorter_files"),
        ).alias("metadata_json"),
    )
    aacid = F.concat(F.lit("aacid__ia2_records__20240102T030405Z__"), "conv_id", F.lit("__x"))
    return items.select(F.col("conv_id").alias("seq"), _line(aacid, meta))


_FILES = """
turns as (select conv_id, turn // 50 as part, turn, md5(text) as md5, role, length(text) as n_text,
                 count(*) over (partition by conv_id, turn // 50) as n from conversations),
firsts as (select *, row_number() over (partition by conv_id, part, md5 order by turn) as again from turns),
heads as (select *, row_number() over (partition by conv_id, part order by turn) as place from turns)"""


@query(f"""with {_FILES}
select conv_id as seq, 'kept' as outcome, md5, 'Item ' || conv_id as title,
  'West, A|Doe, B|C|D' as authors, case when conv_id + 1000 <= 2100 then conv_id + 1000
    when left((conv_id + 1000)::varchar, 4)::int between 1000 and 2100 then left((conv_id + 1000)::varchar, 4)::int
    end as year, 'OL1M|OL22W' as ol, '12' as oclc, 'eng' as languages, 'txt' as extension,
  case when role = 'user' then n_text end as filesize, null as discard_reason
from firsts where again = 1 and n >= 4
union all
select conv_id, 'discarded', md5, null, '', null, '', '', '', null, null, 'ia_mediatype:audio'
from heads where n < 4 and place = 1""")
def adapter_ia2(spark: SparkSession, folder: str) -> DataFrame:
    """Items with several files, repeated files once."""
    rows = adapt(ia2_lines(spark, folder), adapters.IA2)
    return rows.select(
        "seq", "outcome", "md5", "title", joined("authors").alias("authors"),
        F.col("publication_year").alias("year"), joined("openlibrary_ids").alias("ol"),
        joined("oclc").alias("oclc"), joined("languages").alias("languages"), "extension", "filesize",
        "discard_reason",
    )


def upload_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A page is an uploaded file; its host decides about the group and what the file tells."""
    p = spread(table(spark, folder, "pages"))
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    kind = F.regexp_extract("url", r"\.(com|net|org)", 1)
    secure = F.col("url").startswith("https")
    group = F.when(kind == "org", F.lit("magzdb")).when(kind == "net", F.lit("shuge"))
    aacid = F.concat(
        F.lit("aacid__upload_records_"), F.coalesce(F.concat(group, F.lit("__")), F.lit("_")),
        F.lit("20240102T030405Z__"), "page_id", F.lit("__x"),
    )
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    meta = F.struct(
        _md5("html").alias("md5"),
        F.concat(F.lit("id"), "page_id").alias("primary_id"),
        F.col("url").alias("filepath"),
        F.when(~secure & (kind == "net"), F.lit("unknown")).otherwise(
            F.length("html").cast("string")
        ).alias("filesize"),
        F.when(
            secure,
            F.struct(
                title.alias("Title"), F.concat(host, F.lit("; ;"), kind).alias("Author"),
                F.lit("2008:05:06").alias("CreateDate"), F.array(F.lit(""), F.lit("german")).alias("Language"),
            ),
        ).alias("exiftool_output"),
        F.when(
            ~secure,
            F.struct(
                F.concat(F.lit(" "), title).alias("/Title"),
                F.when(kind != "com", host).alias("/Author"), F.lit("D:1999").alias("/CreationDate"),
            ),
        ).alias("pikepdf_docinfo"),
        secure.alias("deleted_as_duplicate"),
    )
    return p.select(F.col("page_id").alias("seq"), _line(aacid, meta))


@query("""
with p as (
  select page_id, md5(html) as md5, length(html) as n_html, starts_with(url, 'https') as secure, regexp_extract(url, '^https?://([^/]*)', 1) as host,
    regexp_extract(url, '\\.(com|net|org)', 1) as kind, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title
  from pages),
o as (
  select *, case when kind = 'org' then 'blocked_subcollection:magzdb'
      when title = '' or (not secure and kind = 'com') then 'missing_title_or_author' end as reason,
    case when secure then host || '|' || kind when kind <> 'com' then host else '' end as names
  from p),
r as (select *, case when reason is not null then 'discarded' when not secure and kind = 'net' then 'failed'
                else 'kept' end as outcome from o)
select page_id as seq, outcome, case when outcome <> 'failed' then md5 end as md5,
  case when outcome <> 'failed' then nullif(title, '') end as title,
  case when outcome <> 'failed' then names else '' end as authors,
  case when outcome = 'kept' then case when secure then 2008 else 1999 end end as year,
  case when outcome = 'kept' and secure then 'deu' else '' end as languages,
  case when outcome = 'kept' then n_html end as filesize,
  outcome = 'kept' and secure as deleted, case when outcome = 'discarded' then reason end as discard_reason,
  case when outcome <> 'failed' then 'id' || page_id end as record_id
from r""")
def adapter_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """P3/F1/F2."""
    rows = adapt(upload_lines(spark, folder), adapters.UPLOADS)
    return rows.select(
        "seq", "outcome", "md5", "title", joined("authors").alias("authors"),
        F.col("publication_year").alias("year"), joined("languages").alias("languages"), "filesize",
        "deleted", "discard_reason", F.col("source_record_id").alias("record_id"),
    )


def goodreads_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A customer is a book; those of one market segment have broken XML, those of another no id."""
    people = spread(table(spark, folder, "customer")).join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    segment = F.col("c_mktsegment")
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<Response><book><id>1</id><title><![CDATA['),
        "c_name", F.lit(" & more]]></title><isbn>123456789X</isbn><isbn13/><publisher>"), "n_name",
        F.lit("</publisher><language_code>ger</language_code><publication_year>"),
        F.when(segment == "MACHINERY", F.lit("")).otherwise(F.lit("1974")),
        F.lit("</publication_year><authors><author><id>1</id><name>"), "n_name",
        F.lit("</name></author><author><name><![CDATA[A; B]]></name></author></authors>"
              "<work><original_publication_year>1927</original_publication_year></work></book>"),
        F.when(segment == "BUILDING", F.lit("<open>")).otherwise(F.lit("")), F.lit("</Response>"),
    )
    meta = F.struct(
        F.when(segment != "FURNITURE", F.col("c_custkey")).alias("id"), xml.alias("record")
    )
    aacid = F.concat(F.lit("aacid__goodreads_records__20240102T030405Z__"), "c_custkey", F.lit("__x"))
    return people.select(F.col("c_custkey").alias("seq"), _line(aacid, meta))


@query("""
with r as (
  select *, case c_mktsegment when 'FURNITURE' then 'skipped' when 'BUILDING' then 'failed' else 'kept' end as outcome
  from customer join nation on c_nationkey = n_nationkey)
select c_custkey as seq, outcome,
  case when outcome = 'kept' then left(sha256('goodreads_records|' || c_custkey), 32) end as md5,
  case when outcome = 'kept' then c_name || ' & more' end as title,
  case when outcome = 'kept' then n_name || '|A|B' else '' end as authors,
  case when outcome = 'kept' then n_name end as publisher,
  case when outcome = 'kept' then case when c_mktsegment = 'MACHINERY' then 1927 else 1974 end end as year,
  case when outcome = 'kept' then 'deu' else '' end as languages,
  case when outcome = 'kept' then '9781234567897' else '' end as isbns
from r""")
def adapter_goodreads(spark: SparkSession, folder: str) -> DataFrame:
    """P4."""
    rows = adapt(goodreads_lines(spark, folder), adapters.GOODREADS)
    return rows.select(
        "seq", "outcome", "md5", "title", joined("authors").alias("authors"), "publisher",
        F.col("publication_year").alias("year"), joined("languages").alias("languages"),
        joined("isbn13").alias("isbns"),
    )


def gbooks_lines(spark: SparkSession, folder: str) -> DataFrame:
    """An order is a volume; the priority decides about the print type."""
    p = F.col("o_orderpriority")
    key = F.col("o_orderkey").cast("string")
    meta = F.struct(
        F.when(p != "5-LOW", F.concat(F.lit("v"), key)).alias("id"),
        F.array(
            F.struct(F.lit("ISBN_13").alias("type"), F.concat(F.lit("978"), F.lpad(key, 10, "0")).alias("identifier")),
            F.struct(F.lit("OTHER").alias("type"), F.lit(" ").alias("identifier")),
        ).alias("industryIdentifiers"),
        F.concat(F.lit(" Volume "), key).alias("title"),
        F.array(F.lit("D S"), F.lit("X & Y"), F.lit("Last, First")).alias("authors"),
        F.when(p == "1-URGENT", F.lit("MAGAZINE")).when(p != "2-HIGH", F.lit("BOOK")).alias("printType"),
        F.lit("en").alias("language"),
        F.date_format(utc("o_orderdate"), "yyyy-MM-dd").alias("publishedDate"),
    )
    aacid = F.concat(F.lit("aacid__gbooks_records__20240102T030405Z__"), key)
    return spread(table(spark, folder, "orders")).select(F.col("o_orderkey").alias("seq"), _line(aacid, meta))


@query("""
with r as (
  select *, '978' || lpad(o_orderkey::varchar, 10, '0') as i,
    case o_orderpriority when '5-LOW' then 'skipped' when '1-URGENT' then 'discarded' else 'kept' end as outcome
  from orders)
select o_orderkey as seq, outcome,
  case when outcome <> 'skipped' then left(sha256('gbooks_records|v' || o_orderkey), 32) end as md5,
  case when outcome = 'kept' then 'Volume ' || o_orderkey end as title,
  case when outcome = 'kept' then 'D S|X|Y|Last, First' else '' end as authors,
  case when outcome = 'kept' then year(o_orderdate) end as year,
  case when outcome = 'kept' and list_sum([i[j]::int * (case when j % 2 = 1 then 1 else 3 end)
    for j in range(1, 14)]) % 10 = 0 then i else '' end as isbns,
  case when outcome = 'discarded' then 'gbooks_printtype:MAGAZINE' end as discard_reason
from r""")
def adapter_gbooks(spark: SparkSession, folder: str) -> DataFrame:
    """P5/F4."""
    rows = adapt(gbooks_lines(spark, folder), adapters.GBOOKS)
    return rows.select(
        "seq", "outcome", "md5", "title", joined("authors").alias("authors"),
        F.col("publication_year").alias("year"), joined("isbn13").alias("isbns"), "discard_reason",
    )


def libby_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A part is a title; its type is the media type."""
    size = F.col("p_size")
    media = (
        F.when(F.col("p_type") == "ECONOMY", F.lit("EBook")).when(F.col("p_type") == "STANDARD", F.lit("audiobook"))
        .when(F.col("p_type") == "SMALL", F.lit("")).otherwise(F.lower("p_type"))
    )
    meta = F.struct(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.when(size > 10, F.struct(media.alias("id"), F.lit("n").alias("name"))).otherwise(
            F.struct(F.lit("").alias("id"), media.alias("name"))
        ).alias("type"),
        F.when(
            size > 20,
            F.array(
                F.struct(F.concat(F.lit(" "), "p_brand").alias("name"), F.lit("Co-Author").alias("role")),
                F.struct(F.lit("N").alias("name"), F.lit("Narrator").alias("role")),
            ),
        ).alias("creators"),
        F.when(size > 5, F.lit("First Name")).alias("firstCreatorName"),
        F.array(
            F.struct(F.lit("de").alias("id")), F.struct(F.lit("English").alias("id")), F.struct(F.lit("DE").alias("id"))
        ).alias("languages"),
        F.when(size > 30, F.struct(F.lit("Pub").alias("name"))).alias("publisher"),
        F.struct(F.lit("Imp").alias("name")).alias("imprint"),
        F.lit("2021-03-01T00:00:00").alias("publishDate"),
        F.col("p_brand").alias("edition"),
    )
    return table(spark, folder, "part").select(F.col("p_partkey").alias("seq"), _line(F.lit("x"), meta))


@query("""
with r as (
  select *, case p_type when 'ECONOMY' then 'ebook' when 'STANDARD' then 'audiobook' when 'SMALL' then ''
    else lower(p_type) end as t from part),
o as (select *, case when p_type = 'SMALL' and p_size > 10 then 'n' else t end as media from r),
k as (select *, case when media in ('ebook', 'audiobook', '') then 'kept' else 'discarded' end as outcome from o)
select p_partkey as seq, outcome, left(sha256('libby_records|' || p_partkey), 32) as md5,
  case when outcome = 'kept' then p_name end as title,
  case when outcome <> 'kept' then '' when p_size > 20 then p_brand when p_size > 5 then 'First Name' else '' end
    as authors,
  case when outcome = 'kept' then case when p_size > 30 then 'Pub' else 'Imp' end end as publisher,
  case when outcome = 'kept' then 'deu|eng' else '' end as languages,
  case when outcome = 'kept' then p_brand end as edition, case when outcome = 'kept' then 2021 end as year,
  case when outcome <> 'kept' then 'libby_type:' || media end as discard_reason
from k""")
def adapter_libby(spark: SparkSession, folder: str) -> DataFrame:
    """P6/F5."""
    rows = adapt(libby_lines(spark, folder), adapters.LIBBY)
    return rows.select(
        "seq", "outcome", "md5", "title", joined("authors").alias("authors"), "publisher",
        joined("languages").alias("languages"), "edition", F.col("publication_year").alias("year"),
        "discard_reason",
    )


def mixed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all collections, with plain texts (no JSON) and lines of an unknown collection."""
    parts = {
        adapters.ZLIB3: zlib3_lines, adapters.IA2: ia2_lines, adapters.UPLOADS: upload_lines,
        adapters.GOODREADS: goodreads_lines, adapters.GBOOKS: gbooks_lines, adapters.LIBBY: libby_lines,
    }
    rows = None
    for name, lines in parts.items():
        part = lines(spark, folder).select(F.lit(name).alias("collection"), "seq", "line")
        rows = part if rows is None else rows.unionByName(part)
    texts = table(spark, folder, "benchmark").select(
        F.lit(adapters.ZLIB3).alias("collection"), (-F.col("item_id") - 1).alias("seq"), F.col("text").alias("line")
    )
    unknown = table(spark, folder, "supplier").select(
        F.lit("other_records").alias("collection"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("line")
    )
    return rows.unionByName(texts).unionByName(unknown)


_COUNTS = f"""{_FILES},
u as (select starts_with(url, 'https') as secure, regexp_extract(url, '\\.(com|net|org)', 1) as kind,
        trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title from pages),
uo as (select case when kind = 'org' then 'blocked_subcollection:magzdb'
        when title = '' or (not secure and kind = 'com') then 'missing_title_or_author'
        when not secure and kind = 'net' then 'failed' else 'kept' end as o from u),
l as (select case when p_type in ('ECONOMY', 'STANDARD') then 'kept'
        when p_type = 'SMALL' then case when p_size > 10 then 'libby_type:n' else 'kept' end
        else 'libby_type:' || lower(p_type) end as o from part),
every as (
  select case when lang = 'es' then 'skipped' else 'kept' end as o, 1 as n, 1 as seen from documents
  union all select 'kept', 1, 0 from firsts where again = 1 and n >= 4
  union all select 'none', 0, 1 from (select distinct conv_id, part from turns where n >= 4)
  union all select 'ia_mediatype:audio', 1, 1 from (select distinct conv_id, part from turns where n < 4)
  union all select o, 1, 1 from uo
  union all select case c_mktsegment when 'FURNITURE' then 'skipped' when 'BUILDING' then 'failed' else 'kept' end,
    1, 1 from customer
  union all select case o_orderpriority when '5-LOW' then 'skipped'
    when '1-URGENT' then 'gbooks_printtype:MAGAZINE' else 'kept' end, 1, 1 from orders
  union all select o, 1, 1 from l
  union all select 'failed', 1, 1 from benchmark
  union all select 'failed', 1, 1 from supplier)"""


@query(f"""with {_COUNTS}
select sum(seen)::bigint as seen, (sum(n) filter (where o = 'kept'))::bigint as kept,
  (sum(n) filter (where o = 'skipped'))::bigint as skipped,
  (sum(n) filter (where o not in ('kept', 'skipped', 'failed')))::bigint as discarded,
  (sum(n) filter (where o = 'failed'))::bigint as failed from every""")
def mixed_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters over a dump of all collections."""
    return import_counters(adapt_mixed(mixed_lines(spark, folder)))


@query(f"""with {_COUNTS}
select o as discard_reason, count(*) as n from every where o not in ('kept', 'skipped', 'failed', 'none') group by 1""")
def mixed_discards(spark: SparkSession, folder: str) -> DataFrame:
    """F1-F5/A5."""
    rows = adapt_mixed(mixed_lines(spark, folder))
    return discard_counts(rows.filter(F.col("outcome") == "discarded"))


@query("""
select -item_id - 1 as seq, 'ParseError: not a usable JSON object :: ' || substr(text, 1, 200) as error
from benchmark order by seq limit 20""")
def failed_samples(spark: SparkSession, folder: str) -> DataFrame:
    """S7."""
    lines = mixed_lines(spark, folder).filter(F.col("collection") == adapters.ZLIB3)
    return error_samples(adapt(lines, adapters.ZLIB3))


# ---- files and streams ----------------------------------------------------------------------


def _written_lines(lines: DataFrame, label: str, files: int) -> str:
    """Text files in the shared folder."""
    path = new_dir(lines.sparkSession, label)
    lines.select("line").repartition(files).write.mode("overwrite").text(path)
    return path


#: Characters of text in one file of a dump.
DUMP_FILE = 32 << 20


def _dump_files(spark: SparkSession, folder: str) -> int:
    """Into how many files a dump of the documents is written: four, or more of a bounded size."""
    chars = table(spark, folder, "documents").agg(F.sum("n_chars")).first()[0] or 0
    return max(4, -(-chars // DUMP_FILE))


def _written_dump(lines: DataFrame, label: str, files: int) -> str:
    """Four dump files of unequal size, the later ones larger; copies of a key go to several of them. Where there are to be more files,
    each of the four is a run of files in the order of their names."""
    path = new_dir(lines.sparkSession, label)
    file = F.when(F.col("seq") % 10 < 1, 0).when(F.col("seq") % 10 < 3, 1).when(F.col("seq") % 10 < 5, 2).otherwise(3)
    dealt = lines.select(file.alias("file"), "seq", "line").repartitionByRange(files, *(["file"] if files == 4 else ["file", "seq"]))
    dealt.sortWithinPartitions("file", "seq").select("line").write.mode("overwrite").text(path)
    return path


# Lines arrive by file, then by document: the last one names the record, authors are listed as they come.
_IMPORTED = """
with d as (
  select *, md5(text) as md5, case when doc_id % 10 < 1 then 0 when doc_id % 10 < 3 then 1
    when doc_id % 10 < 5 then 2 else 3 end as file from documents left join labels using (doc_id) where lang <> 'es'),
people as (
  select md5, file, doc_id, unnest([1, 2]) as i, unnest([source, lang]) as name from d),
listed as (select md5, name, min([file, doc_id, i]) as spot from people group by all),
named as (select md5, string_agg(name, '|' order by spot) as authors from listed group by 1)
select md5, any_value(trim(text, ' \n\t\r')) as title, any_value(authors) as authors,
  'aacid__zlib3_records__20240102T030405Z__' || arg_max(doc_id, [file, doc_id]) || '__x' as aacid,
  coalesce(bool_or(toxic = 1), false) as deleted
from d join named using (md5) group by 1"""


def _imported(records: DataFrame) -> DataFrame:
    return records.select("md5", "title", joined("authors").alias("authors"), "aacid", "deleted")


@query(_IMPORTED)
def file_import_order(spark: SparkSession, folder: str) -> DataFrame:
    """The same dump cut into many small pieces arrives in the same order. Of a dump of more files they are larger, so that
    about two thousand pieces are the most."""
    files = _dump_files(spark, folder)
    path = _written_dump(zlib3_lines(spark, folder), "dump", files)
    keys = {"spark.sql.files.maxPartitionBytes": f"{64 * files // 4}k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        parsed = import_release(spark, path, adapters.ZLIB3).parsed  # written, so the cuts are made here
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = parsed.filter(F.col("outcome") == "kept")
    return _imported(with_derived(upsert_merge(rows.limit(0), rows), score=False))


@query(_IMPORTED)
def file_import(spark: SparkSession, folder: str) -> DataFrame:
    """A dump of files imported in one go."""
    path = _written_dump(zlib3_lines(spark, folder), "dump", _dump_files(spark, folder))
    return _imported(import_release(spark, path, adapters.ZLIB3).records)


@query("select count(*) as lines, count(distinct text) as texts from benchmark")
def line_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files, blank ones left out."""
    texts = table(spark, folder, "benchmark").select(
        F.explode(F.array(F.concat(F.lit("  "), F.translate("text", "\r\n", "  ")), F.lit("   "))).alias("line")
    )
    return read_lines(spark, _written_lines(texts, "lines", 3), tolerant=True).agg(
        F.count("*").alias("lines"), F.countDistinct("line").alias("texts")
    )


def damaged_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content): payloads of a hundred documents in four gzip members each. Even ones end before their last member does,
    odd ones have zeros in the middle of the second."""
    path = new_dir(spark, "members")
    lines = zlib3_lines(spark, folder).withColumns({"payload": F.floor(F.col("seq") / 100), "member": F.col("seq") % 4})
    lines = lines.repartition("payload", "member")
    lines.select("payload", "member", "line").write.partitionBy("payload", "member").option("compression", "gzip").text(path)
    place = lambda name: F.regexp_extract("file", f"{name}=([0-9]+)", 1).cast("long")
    files = payloads(spark, f"{path}/*/*").select(place("payload").alias("payload"), place("member").alias("member"), "content")
    cut = F.expr("substring(content, 1, length(content) - 9)")
    zeros = F.concat(F.expr("substring(content, 1, 60)"), F.lit(bytes(40)), F.expr("substring(content, 101)"))
    even = F.col("payload") % 2 == 0
    damaged = F.when(even & (F.col("member") == 3), cut).when(~even & (F.col("member") == 1), zeros).otherwise(F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("member", damaged.alias("content"))))
    whole = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["content"]))  # a hundred documents
    return files.groupBy("payload").agg(whole.alias("content")).select(F.col("payload").cast("string").alias("file"), "content")


@query("""
select doc_id // 100 as payload, count(*) filter (where doc_id % 4 <> if(doc_id // 100 % 2 = 0, 3, 1)) as lines,
  1 as breaks, if(doc_id // 100 % 2 = 0, 3, 1) as broken_frame from documents group by doc_id // 100""")
def salvaged_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """S3: what whole frames of damaged payloads hold, and which frame broke; the frames after it are read too."""
    frames = written(read_frames(damaged_payloads(spark, folder), partial=False), "frames")
    broken = breaks(frames).groupBy("file").agg(F.count("*").alias("breaks"), F.min("frame").alias("broken_frame"))
    lines = salvaged(frames).groupBy("file").agg(F.count("*").alias("lines"))
    return broken.join(lines, "file").select(F.col("file").cast("long").alias("payload"), "lines", "breaks", "broken_frame")


_PIECES = """
with r as (
  select c_nationkey as payload, c_custkey % 7 as piece, case c_mktsegment when 'BUILDING' then 1 else 0 end as bad
  from customer),
p as (select payload, piece, count(*) as n, sum(bad) as f from r group by 1, 2),
s as (select payload, piece, sum(n) over w as seen, sum(f) over w as failed from p
      window w as (partition by payload order by piece)),
stop as (select payload, min(piece) as piece from s where seen >= 10 and failed > 0.25 * seen group by 1),
last as (select payload, max(piece) as piece from s group by 1)"""


@query(f"""{_PIECES}
select s.payload, s.seen::bigint as seen, s.failed::bigint as failed, stop.piece as stopped_after,
  case when stop.piece is not null or s.failed > 0.25 * s.seen then 'aborted' else 'kept' end as outcome
from last left join stop using (payload)
join s on s.payload = last.payload and s.piece = coalesce(stop.piece, last.piece)""")
def gate_by_payload(spark: SparkSession, folder: str) -> DataFrame:
    """The books of a nation are a payload of seven pieces; more than a quarter of broken ones after ten lines ends it."""
    lines = goodreads_lines(spark, folder)
    keys = table(spark, folder, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_nationkey").alias("payload"))
    rows = adapt(lines, adapters.GOODREADS).select("seq", "part", "outcome").join(keys, "seq")
    rows = rows.withColumn("piece", F.col("seq") % 7)
    return gate_outcomes(rows, "payload", "piece", abort_rate=0.25, check_after=10)


@query(_IMPORTED)
def stream_import(spark: SparkSession, folder: str) -> DataFrame:
    """The same dump as a stream of files in several micro-batches, staged and folded; the
    second release repeats the first one and changes nothing."""
    files = _dump_files(spark, folder)
    path = _written_dump(zlib3_lines(spark, folder), "dump", files)
    base = new_dir(spark, "catalogue")
    records = None
    for rank in (1, 2):
        stage_stream(spark, path, adapters.ZLIB3, base, rank, max_files=-(-files // 2)).awaitTermination()
        records = fold_staged(spark, base, rank)
    return _imported(records)


@query("""
select count(*) as seen, count(*) filter (where lang <> 'es') as kept, count(*) filter (where lang = 'es') as skipped,
  0 as discarded, 0 as failed from documents""")
def stream_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters observed while the stream is staged, summed over its micro-batches."""
    files = _dump_files(spark, folder)
    path = _written_dump(zlib3_lines(spark, folder), "dump", files)
    base = new_dir(spark, "catalogue")
    stage_stream(spark, path, adapters.ZLIB3, base, 1, max_files=-(-files // 4)).awaitTermination()
    return staged_counters(spark, base, 1)


def event_stream(spark: SparkSession, folder: str, files: int = 4) -> DataFrame:
    """The events in the order of their time, in several files that a stream takes one at a time. The last two files hold a mark
    each, of no type, days later: the first moves the watermark, the batch of the second closes what is still open."""
    events, path = table(spark, folder, "events").withColumn("ts", utc("ts")), new_dir(spark, "events")
    micros = F.unix_micros("ts")
    cuts = events.select(micros.alias("at")).approxQuantile("at", [i / files for i in range(1, files)], 0.01)
    edges = [None, *(int(c) for c in cuts), None]
    for low, high in zip(edges, edges[1:]):  # one after the other: a stream takes files by their age
        part = events.filter((F.lit(low is None) | (micros > low)) & (F.lit(high is None) | (micros <= high)))
        part.coalesce(1).write.mode("append").parquet(path)
    for days in (1, 2):
        mark = events.agg((F.max("ts") + F.make_dt_interval(days=F.lit(days))).alias("ts"))
        mark = mark.select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))
        mark.write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(BUCKET_SQL)
def stream_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Buckets of a stream of several micro-batches; every update of a bucket replaces the earlier one."""
    out = new_dir(spark, "buckets")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch-{batch_id}")

    events = event_stream(spark, folder).filter(F.col("event_type").isNotNull())
    stream = performance_buckets(samples(events)).writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True)
    stream.option("checkpointLocation", new_dir(spark, "state")).start().awaitTermination()
    updates = spark.read.parquet(f"{out}/*")
    rest = [c for c in updates.columns if c not in ("release_id", "bucket_start", "batch")]
    last = updates.groupBy("release_id", "bucket_start").agg(
        F.max_by(F.struct(*rest), "batch").alias("r")
    )
    return bucket_columns(last.select("release_id", "bucket_start", "r.*"))


def _streamed(rows: DataFrame, label: str) -> DataFrame:
    """What a stream appends, as a table."""
    spark, out = rows.sparkSession, new_dir(rows.sparkSession, label)
    stream = rows.writeStream.format("parquet").option("path", out).trigger(availableNow=True)
    stream.option("checkpointLocation", new_dir(spark, "state")).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query("select distinct user_id, event_type from events")
def stream_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Repeats within the watermark are dropped in the stream, over several micro-batches."""
    events = event_stream(spark, folder)
    once = distinct_records(events, ["user_id", "event_type"], watermark="90 days").filter(F.col("event_type").isNotNull())
    return _streamed(once.select("user_id", "event_type"), "distinct")


@query("""
with e as (select event_type, user_id, ts, ts - lag(ts) over (partition by event_type, user_id order by ts) as gap from events),
b as (select event_type, user_id, ts, sum(if(gap < interval 12 hour, 0, 1)) over (partition by event_type, user_id order by ts
      rows unbounded preceding) as burst from e)
select event_type, user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_at,
  count(*) as n from b group by event_type, user_id, burst""")
def stream_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """T7 with expiry: repeats are let through again after half a day without one."""
    bursts = first_of_bursts(event_stream(spark, folder), ["event_type", "user_id"], gap="12 hours", watermark="10 minutes")
    rows = _streamed(bursts, "bursts").filter(F.col("event_type").isNotNull())  # in the stream it would take the marks away first
    as_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("event_type", "user_id", as_text("first_at"), as_text("last_at"), "n")
