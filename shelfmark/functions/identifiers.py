"""Keys and identifiers: checksums, ISBN, DOI, release names, record references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import bind, strip

# Separators removed from ISBNs (whitespace, hyphen-minus, U+2010..U+2015), the shape
# of store numbers that only look like ISBNs, the DOI resolver prefixes and DOI shape, and the
# layouts of record references and release names.
ISBN_SEPARATORS = r"(?U)[\s\-\x{2010}-\x{2015}]"
STORE_NUMBER = r"^B[0-9A-Z]{9}$"
DOI_RESOLVERS = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:|info:doi/)"
DOI_SHAPE = r"^(10\.\d{4,9})(/\S+)$"
OPEN_LIBRARY_ID = r"^OL\d+[MW]$"
RECORD_STAMP = r"__(\d{8}T\d{6}Z)__"
UPLOAD_GROUP = r"^aacid__upload_records_(?:([a-z0-9_]+?)__)?\d{8}T\d{6}Z__"
RELEASE_NAME = (
    r"^annas_archive_meta__aacid__([a-z0-9_]+?)__"
    r"(\d{8}T\d{6}Z)--(\d{8}T\d{6}Z)\.jsonl\.seekable\.zst$"
)
STAMP_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
STAMP_PARSE = "yyyyMMdd'T'HHmmssX"  # the Z is read as the zone, whatever the session's zone is


def md5_hex(c: Column) -> Column:
    """32 lower-case hex digits, or null."""
    low = F.lower(strip(c))
    return F.when(low.rlike("^[0-9a-f]{32}$"), low)


def md5_bytes(c: Column) -> Column:
    """The 16-byte form."""
    return F.unhex(md5_hex(c))


def synthetic_md5(collection: str, record_id: Column) -> Column:
    """Stable stand-in key for records without a file checksum; blank id gives null."""
    digest = F.sha2(F.concat(F.lit(collection + "|"), record_id), 256)
    return F.when(strip(record_id) != "", F.substring(digest, 1, 32))


def _weighted_digits(digits: Column, weights: list[int]) -> Column:
    """Sum of the decimal digits of a text times their weights; null when it is no number."""
    terms = [f"(n div {10**place}L) % 10 * {w}" for place, w in enumerate(reversed(weights))]
    number = F.array(digits.try_cast("long"))
    return F.get(F.call_function("transform", number, F.expr("n -> " + " + ".join(terms))), F.lit(0))


_WEIGHTS_13 = [3 if i % 2 else 1 for i in range(13)]
_WEIGHTS_10 = list(range(10, 1, -1))
# the check digit of a 978-form: 978 itself weighs 38, the weights go on from there
_WEIGHTS_978 = _WEIGHTS_13[3:12]


def clean_isbn(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, ISBN_SEPARATORS, ""))


def is_isbn13(c: Column) -> Column:
    check = F.when(c.rlike("^[0-9]{13}$"), _weighted_digits(c, _WEIGHTS_13))
    return F.coalesce(check % 10 == 0, F.lit(False))


def is_isbn10(c: Column) -> Column:
    last = F.substring(c, 10, 1)
    check = F.when(
        c.rlike("^[0-9]{9}[0-9X]$"),
        _weighted_digits(F.substring(c, 1, 9), _WEIGHTS_10)
        + F.when(last == "X", F.lit(10)).otherwise(last.try_cast("int")),
    )
    return F.coalesce(check % 11 == 0, F.lit(False))


def isbn10_to_13(c: Column) -> Column:
    """The 978-form of a valid ISBN-10."""
    body = F.substring(c, 1, 9)
    check = F.pmod(-(_weighted_digits(body, _WEIGHTS_978) + 38), F.lit(10))
    return F.concat(F.lit("978"), body, check.cast("string"))


def _isbn13_of_clean(c: Column) -> Column:
    return F.when(is_isbn13(c), c).when(is_isbn10(c), isbn10_to_13(c))


def normalize_isbn13(c: Column) -> Column:
    """X3."""
    return bind(clean_isbn(c), _isbn13_of_clean)


def normalize_isbn10(c: Column) -> Column:
    """X4."""
    return bind(clean_isbn(c), lambda x: F.when(is_isbn10(x), x))


def isbn13_list(values: Column) -> Column:
    """Distinct ISBN-13 forms of a list, order kept; a valid ISBN-10 counts by its 978-form."""
    # cleaned in a pass of its own: within a lambda every use of an expression computes it again
    forms = F.transform(F.transform(values, clean_isbn), _isbn13_of_clean)
    kept = F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))
    return F.coalesce(kept, F.array().cast("array<string>"))


def isbn10_list(values: Column) -> Column:
    """Distinct ISBN-10 forms with no 978-form, store numbers left out.

    Every valid ISBN-10 has a 978-form, so this list is empty for well-formed input.
    """
    clean = F.transform(values, clean_isbn)
    kept = F.filter(
        clean,
        lambda x: _isbn13_of_clean(x).isNull() & ~x.rlike(STORE_NUMBER) & is_isbn10(x),
    )
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def normalize_doi(c: Column) -> Column:
    """X8."""

    def shaped(bare: Column) -> Column:
        registrant = F.regexp_extract(bare, DOI_SHAPE, 1)
        return F.when(
            registrant != "", F.concat(F.lower(registrant), F.regexp_extract(bare, DOI_SHAPE, 2))
        )

    return bind(F.rtrim(strip(F.regexp_replace(strip(c), DOI_RESOLVERS, "")), F.lit(".")), shaped)


def work_key(isbn13: Column, isbn10: Column, doi: Column, openlibrary_ids: Column) -> Column:
    """Key of the work a file belongs to, from the most reliable identifier present."""

    def first(prefix: str, ids: Column) -> Column:
        return F.concat(F.lit(prefix), F.try_element_at(ids, F.lit(1)))

    return F.coalesce(
        first("isbn:", isbn13), first("isbn:", isbn10), first("doi:", doi), first("ol:", openlibrary_ids)
    )


def record_timestamp(aacid: Column) -> Column:
    """The UTC time inside a record reference; impossible dates give null."""
    stamp = F.nullif(F.regexp_extract(aacid, RECORD_STAMP, 1), F.lit(""))
    return F.try_to_timestamp(stamp, F.lit(STAMP_PARSE))


def upload_group(aacid: Column) -> Column:
    """Sub-collection of an upload record reference, or null."""
    return F.nullif(F.regexp_extract(aacid, UPLOAD_GROUP, 1), F.lit(""))


def release_parts(name: Column) -> Column:
    """struct(collection, from_stamp, to_stamp), null when the name is no release."""
    part = [F.regexp_extract(name, RELEASE_NAME, i) for i in (1, 2, 3)]
    return F.when(
        name.rlike(RELEASE_NAME),
        F.struct(
            part[0].alias("collection"), part[1].alias("from_stamp"), part[2].alias("to_stamp")
        ),
    )
