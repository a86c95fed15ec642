"""Scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import fields, identifiers, languages, maps, text
from shelfmark.plans.queries.registry import joined, query, spread, sql_norm, sql_words, table, utc

_LANGUAGE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in languages.LANGUAGE_CODES.items())


def _sql_language(x: str) -> str:
    low = f"nullif(lower(trim({x})), '')"
    return (
        f"coalesce(langs[{low}], langs[nullif(regexp_extract({low}, '^([a-z]{{2,3}})[-_]', 1), '')],"
        f" case when regexp_full_match({low}, '\\p{{L}}{{3}}') then {low} end)"
    )


_LANGS = (
    "langs_t as (select map_from_entries(list((k, v))) as langs from (values "
    + _LANGUAGE_ROWS
    + ") t(k, v))"
)


@query(f"select doc_id, {sql_norm('text')} as norm from documents")
def text_normalize(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents"))
    return docs.select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query(f"""
select token, count(*) as n_docs
from (select distinct doc_id, unnest({sql_words(sql_norm('text'))}) as token from documents)
group by token""")
def tokens_distinct(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents"))
    words = docs.select(F.explode(text.distinct_tokens(text.normalize_text(F.col("text")))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n_docs"))


@query(f"""
with {_LANGS}, raw as (
  select unnest([lang, upper(lang), ' ' || lang || ' ', lang || '-XX', lang || '_' || source, source,
                 lang || 'q']) as raw from documents
  union all select regexp_extract(html, 'lang="([^"]*)"', 1) from pages)
select raw, {_sql_language('raw')} as code, count(*) as n from raw, langs_t group by 1, 2""")
def language_codes(spark: SparkSession, folder: str) -> DataFrame:
    lang = F.col("lang")
    forms = F.array(
        lang, F.upper(lang), F.concat(F.lit(" "), lang, F.lit(" ")), F.concat(lang, F.lit("-XX")),
        F.concat_ws("_", lang, "source"), F.col("source"), F.concat(lang, F.lit("q")),
    )
    docs = table(spark, folder, "documents").select(F.explode(forms).alias("raw"))
    pages = table(spark, folder, "pages").select(
        F.regexp_extract("html", 'lang="([^"]*)"', 1).alias("raw")
    )
    counted = docs.unionByName(pages).groupBy("raw").agg(F.count("*").alias("n"))
    return counted.select("raw", languages.normalize_language(F.col("raw")).alias("code"), "n")


@query(f"""
with {_LANGS}, parts as (
  select doc_id, generate_subscripts(p, 1) as i, unnest(p) as part from (
    select doc_id, string_split_regex(lang || ';' || source || '/' || upper(lang) || '-xx,en', '[,;/]') as p
    from documents)),
codes as (select doc_id, i, {_sql_language('part')} as code from parts, langs_t),
firsts as (select doc_id, code, min(i) as i from codes where code is not null group by all)
select doc_id, string_agg(code, '|' order by i) as codes from firsts group by doc_id""")
def language_lists(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    raw = F.concat("lang", F.lit(";"), "source", F.lit("/"), F.upper("lang"), F.lit("-xx,en"))
    return docs.select("doc_id", joined(languages.language_list_of_text(raw)).alias("codes"))


def _sql_is13(c: str) -> str:
    return (
        f"(regexp_full_match({c}, '[0-9]{{13}}') and list_sum([try_cast({c}[i] as int) * "
        f"(case when i % 2 = 1 then 1 else 3 end) for i in range(1, 14)]) % 10 = 0)"
    )


def _sql_is10(c: str) -> str:
    return (
        f"(regexp_full_match({c}, '[0-9]{{9}}[0-9X]') and list_sum([(case when {c}[i] = 'X' then 10 else "
        f"try_cast({c}[i] as int) end) * (11 - i) for i in range(1, 11)]) % 11 = 0)"
    )


def _sql_to13(c: str) -> str:
    core = f"('978' || {c}[1:9])"
    return (
        f"{core} || cast((10 - list_sum([try_cast({core}[i] as int) * (case when i % 2 = 1 then 1 else 3 end) "
        f"for i in range(1, 13)]) % 10) % 10 as varchar)"
    )


def _sql_13(c: str) -> str:
    return f"(case when {_sql_is13(c)} then {c} when {_sql_is10(c)} then {_sql_to13(c)} end)"


@query(f"""
with raw as (
  select o_orderkey, '978' || lpad(cast(o_orderkey as varchar), 10, '0') as a,
         lpad(cast(o_orderkey as varchar), 10, '0') as b,
         lpad(cast(o_orderkey as varchar), 9, '0') || 'X' as x from orders),
forms as (
  select o_orderkey, {_sql_13('a')} as isbn13, {_sql_13('b')} as from10, {_sql_13('x')} as fromx,
         case when {_sql_is10('x')} then x end as isbn10 from raw)
select o_orderkey, isbn13, from10, isbn10,
       list_aggregate([isbn13, case when from10 <> coalesce(isbn13, '') then from10 end,
         case when fromx <> coalesce(isbn13, '') and fromx <> coalesce(from10, '') then fromx end],
         'string_agg', '|') as isbns
from forms""")
def isbn_validate(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    body = F.lpad(key, 10, "0")
    df = spread(table(spark, folder, "orders")).select(
        "o_orderkey",
        F.concat(F.lit("978-"), F.substring(body, 1, 5), F.lit(" "), F.substring(body, 6, 5)).alias("a"),
        F.concat(F.substring(body, 1, 1), F.lit("‐"), F.substring(body, 2, 9)).alias("b"),
        F.concat(F.lpad(key, 9, "0"), F.lit("-x")).alias("x"),
    )
    every = F.array("a", "b", F.lit("B0SHELFMRK"), "x", "a")
    listed = identifiers.isbn13_list(every)
    return df.select(
        "o_orderkey",
        identifiers.normalize_isbn13(F.col("a")).alias("isbn13"),
        identifiers.normalize_isbn13(F.col("b")).alias("from10"),
        identifiers.normalize_isbn10(F.col("x")).alias("isbn10"),
        F.nullif(joined(F.concat(listed, identifiers.isbn10_list(every))), F.lit("")).alias("isbns"),
    )


@query("""
with forms as (
  select p_partkey, unnest(['', 'https://doi.org/', 'HTTP://dx.doi.org/', 'doi:', 'info:doi/', '1']) as form,
         '10.' || cast(1000 + p_size as varchar) || '/' || p_brand || '.' || cast(p_partkey as varchar) as doi
  from part)
select p_partkey, form, case when form <> '1' then doi end as doi from forms""")
def doi_normalize(spark: SparkSession, folder: str) -> DataFrame:
    forms = ["", "https://doi.org/", "HTTP://dx.doi.org/", "doi:", "info:doi/", "1"]
    df = spread(table(spark, folder, "part")).select(
        "p_partkey",
        F.explode(F.array(*[F.lit(f) for f in forms])).alias("form"),
        F.concat_ws("", F.lit("10."), F.col("p_size") + 1000, F.lit("/"), "p_brand", F.lit("."), "p_partkey",
                    F.lit(".. ")).alias("body"),
    )
    raw = F.concat("form", "body")
    return df.select("p_partkey", "form", identifiers.normalize_doi(raw).alias("doi"))


@query("""
with raw as (
  select 'document' as kind, doc_id as id, try_cast(regexp_extract(text, '([0-9]{4})', 1) as int) as y
  from documents
  union all
  select 'page', page_id, try_cast(regexp_extract(html, '([0-9]{4})', 1) as int) from pages)
select kind, id, case when y between 1000 and 2100 then y end as year from raw""")
def year_extract(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents")).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("t")
    )
    pages = spread(table(spark, folder, "pages")).select(F.lit("page"), "page_id", "html")
    return docs.union(pages).select("kind", "id", fields.normalize_year(F.col("t")).alias("year"))


_PATHS = """
with base as (
  select page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) as b from pages),
cut as (select page_id, b, regexp_extract(b, '^.+(\\.[^.]+)$', 1) as suffix from base)
"""


@query(_PATHS + """
select page_id, suffix, case when regexp_full_match(ltrim(lower(suffix), '.'), '[a-z0-9]{1,10}')
                             then ltrim(lower(suffix), '.') end as ext from cut""")
def extension_clean(spark: SparkSession, folder: str) -> DataFrame:
    suffix = text.path_suffix(F.col("url"))
    return table(spark, folder, "pages").select(
        "page_id", suffix.alias("suffix"), fields.normalize_extension(suffix).alias("ext")
    )


@query(_PATHS + """
select page_id, trim(regexp_replace(left(b, length(b) - length(suffix)), '[^\\p{L}\\p{N}]+', ' ', 'g')) as title
from cut""")
def path_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", text.title_from_path(F.col("url")).alias("title")
    )


@query("""
with raw as (
  select 'quantity' as kind, cast(l_quantity * 1000 as bigint) as v from lineitem
  union all select 'line', l_linenumber - 3 from lineitem)
select kind, case when v between 1 and 32767 then v end as pos, count(*) as n from raw group by 1, 2""")
def series_positions(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    thousand = (F.col("l_quantity") * 1000).cast("long").cast("string")
    raw = items.select(
        F.explode(
            F.array(
                F.struct(F.lit("quantity").alias("kind"), thousand.alias("v")),
                F.struct(F.lit("line").alias("kind"), (F.col("l_linenumber") - 3).cast("string").alias("v")),
            )
        ).alias("r")
    ).select("r.kind", fields.normalize_series_position(F.col("r.v")).alias("pos"))
    return raw.groupBy("kind", "pos").agg(F.count("*").alias("n"))


@query("""
with raw as (
  select c_custkey, c_name || '; ' || n_name || ' and ' || c_mktsegment || ' & ' || r_name || ' , '
         || lower(c_name) || ', ' || n_name || ' | ;' as s
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
parts as (
  select c_custkey, [trim(regexp_replace(p, '\\s+', ' ', 'g'), ' ,;') for p in
    string_split_regex(trim(s), '\\s*[;|]\\s*|\\s+,\\s*|\\s*&\\s*|\\s+\\band\\b\\s+')] as a from raw)
select c_custkey, array_to_string([x for x in a if x <> ''], '|') as authors,
       len([x for x in a if x <> '']) as n from parts""")
def author_split(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    people = table(spark, folder, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    raw = F.concat(
        "c_name", F.lit("; "), "n_name", F.lit(" and "), "c_mktsegment", F.lit(" & "), "r_name",
        F.lit(" , "), F.lower("c_name"), F.lit(", "), "n_name", F.lit(" | ;"),
    )
    authors = fields.split_authors(raw)
    return people.select("c_custkey", joined(authors).alias("authors"), F.size(authors).alias("n"))


@query("""
select c_custkey, left(sha256('gbooks_records|' || cast(c_custkey as varchar)), 32) as key from customer""")
def synthetic_keys(spark: SparkSession, folder: str) -> DataFrame:
    key = identifiers.synthetic_md5("gbooks_records", F.col("c_custkey").cast("string"))
    return table(spark, folder, "customer").select("c_custkey", key.alias("key"))


@query("select doc_id, md5(text) as key, cast(null as varchar) as bad from documents")
def md5_keys(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit(" "), F.upper(F.md5(F.col("text").cast("binary"))), F.lit("\n"))
    return table(spark, folder, "documents").select(
        "doc_id",
        F.lower(F.hex(identifiers.md5_bytes(padded))).alias("key"),
        identifiers.md5_hex(F.col("source")).alias("bad"),
    )


@query("""
select event_id, case when event_type in ('error', 'view') then null else event_type end as grp,
       case when event_type <> 'view' then strftime(ts, '%Y-%m-%d %H:%M:%S') end as at
from events""")
def record_references(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    stamp = F.date_format(utc("ts"), identifiers.STAMP_FORMAT)
    group = F.when(F.col("event_type") == "error", F.lit("_")).otherwise(
        F.concat("event_type", F.lit("__"))
    )
    head = F.when(F.col("event_type") == "view", F.lit("aacid__other_")).otherwise(
        F.lit("aacid__upload_records_")
    )
    # views carry a month that does not exist
    stamp = F.when(F.col("event_type") == "view", F.lit("20241301T000000Z")).otherwise(stamp)
    aacid = F.concat(head, group, stamp, F.lit("__"), "user_id", F.lit("__x"))
    df = events.select("event_id", aacid.alias("aacid"))
    return df.select(
        "event_id",
        identifiers.upload_group(F.col("aacid")).alias("grp"),
        F.date_format(identifiers.record_timestamp(F.col("aacid")), "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


@query("""
select p_partkey, p_name as first_one,
       case when p_size > 25 then p_name || '|' || p_brand else p_name end as all_of_them from part""")
def scalar_or_list(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit(" "), "p_name", F.lit(" "))
    shape = F.when(
        F.col("p_size") > 25, F.to_json(F.struct(F.array(F.lit(" "), name, "p_brand").alias("v")))
    ).otherwise(F.to_json(F.struct(name.alias("v"))))
    df = table(spark, folder, "part").select(
        "p_partkey", F.try_variant_get(F.parse_json(shape), "$.v", "variant").alias("v")
    )
    return df.select(
        "p_partkey", text.as_text(F.col("v")).alias("first_one"),
        joined(text.as_list(F.col("v"))).alias("all_of_them"),
    )


@query("""
select p_partkey, case when p_size > 40 then 'isbn:' || cast(p_partkey as varchar)
  when p_size > 30 then 'isbn:' || p_brand when p_size > 20 then 'doi:10.1000/' || p_type
  when p_size > 10 then 'ol:OL1M' end as work_key from part""")
def work_keys(spark: SparkSession, folder: str) -> DataFrame:
    def listed(over: int, value) -> Column:
        none = F.array().cast("array<string>")
        return F.when(F.col("p_size") > over, F.array(value.cast("string"))).otherwise(none)

    key = identifiers.work_key(
        listed(40, F.col("p_partkey")), listed(30, F.col("p_brand")),
        listed(20, F.concat(F.lit("10.1000/"), "p_type")), listed(10, F.lit("OL1M")),
    )
    return table(spark, folder, "part").select("p_partkey", key.alias("work_key"))


@query("""
with names as (
  select case o_orderstatus when 'O' then 'open_records' when 'F' then 'final_records' else 'part_records' end
         as collection, strftime(o_orderdate, '%Y%m%dT000000Z') as stamp, o_orderpriority, o_orderkey, o_totalprice
  from orders)
select collection, max(stamp) as to_stamp, max(stamp || lpad(cast(o_orderkey as varchar), 12, '0')) as newest
from names where o_orderpriority <> '5-LOW' and o_totalprice >= 1000 and collection <> 'part_records'
group by collection""")
def release_latest(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.sources.manifest import latest_releases, releases

    orders = table(spark, folder, "orders")
    stamp = F.date_format(utc("o_orderdate"), identifiers.STAMP_FORMAT)
    name = (
        F.when(F.col("o_orderstatus") == "O", "open_records")
        .when(F.col("o_orderstatus") == "F", "final_records")
        .otherwise("Part-Records")  # upper case and hyphens are no collection name
    )
    manifest = orders.select(
        F.concat(
            F.lit("annas_archive_meta__aacid__"), name, F.lit("__20000101T000000Z--"), stamp,
            F.lit(".jsonl.seekable.zst.torrent"),
        ).alias("display_name"),
        (F.col("o_orderpriority") != "5-LOW").alias("is_metadata"),
        (F.col("o_totalprice") < 1000).alias("obsolete"),
        F.concat(stamp, F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("btih"),
        F.lit("").alias("url"),
        F.lit(None).cast("string").alias("magnet_link"),
        F.col("o_orderkey").alias("data_size"),
    )
    best = latest_releases(releases(manifest), ["open_records", "final_records", "part_records"])
    return best.select("collection", "to_stamp", F.col("btih").alias("newest"))


@query("""
select l_orderkey, coalesce(sum(l_quantity) filter (where l_returnflag = 'A'), 0) as a,
  coalesce(sum(l_quantity) filter (where l_returnflag = 'N'), 0) as n,
  coalesce(sum(l_quantity) filter (where l_returnflag = 'R'), 0) as r,
  max(l_linenumber) filter (where l_linestatus = 'F') as last_f
from lineitem group by l_orderkey""")
def counter_maps(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of the two line states as maps, added key by key."""
    items = table(spark, folder, "lineitem")
    sums = items.groupBy("l_orderkey", "l_linestatus", "l_returnflag").agg(
        F.sum("l_quantity").alias("q"), F.max("l_linenumber").alias("last")
    )
    entry = F.struct("l_returnflag", "q")

    def of(state: str) -> Column:
        kept = F.collect_list(F.when(F.col("l_linestatus") == state, entry))
        return F.map_from_entries(kept)

    per_order = sums.groupBy("l_orderkey").agg(
        of("F").alias("f"), of("O").alias("o"),
        F.max(F.when(F.col("l_linestatus") == "F", F.col("last"))).alias("last_f"),
    )
    both = per_order.select("l_orderkey", maps.add_counters(F.col("f"), F.col("o")).alias("m"), "last_f")
    none = F.lit(0.0)
    return both.select(
        "l_orderkey",
        *[F.coalesce(F.try_element_at("m", F.lit(k)), none).alias(k.lower()) for k in "ANR"],
        "last_f",
    )
