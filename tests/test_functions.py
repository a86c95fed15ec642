"""Scalar functions: input and expected value."""

import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import fields, identifiers, languages, maps, text



def thirteen(n):
    """A made-up ISBN-13 of nine digits."""
    stem = f"978{n:09d}"
    return stem + str(-sum(int(c) * (1, 3)[i % 2] for i, c in enumerate(stem)) % 10)


def ten(n):
    """The ISBN-10 of the same digits."""
    check = sum(int(c) * i for i, c in enumerate(f"{n:09d}", 1)) % 11
    return f"{n:09d}" + ("X" if check == 10 else str(check))


TEN_X = next(n for n in range(600, 700) if ten(n)[-1] == "X")


def dashed(isbn):
    return f"{isbn[:2]}-{isbn[2:5]} {isbn[5:-1]}-{isbn[-1]}"


def wrong(isbn):
    return isbn[:-1] + str((int(isbn[-1]) + 3) % 10)


CASES = {
    "normalize_text": (
        text.normalize_text,
        [
            ("Čapek", "capek"), ("  Two\t\nwords ", "two words"), ("ÉTÉ", "ete"), ("Straße", "strasse"),
            ("ﬁn", "fin"), ("Вой̆на", "воина"), (None, ""), ("", ""), ("İx", "ix"),
            ("a b　c", "a b c"), ("한글", unicodedata.normalize("NFKD", "한글")),
        ],
    ),
    "md5_hex": (
        identifiers.md5_hex,
        [(" " + "AB" * 16, "ab" * 16), ("ab", None), ("g" * 32, None), (None, None), ("0" * 31, None)],
    ),
    "isbn13": (
        identifiers.normalize_isbn13,
        [
            *[(dashed(thirteen(n)), thirteen(n)) for n in (0, 31_415_926, 271_828_182)],
            (f"ISBN {thirteen(7)}", None), (thirteen(7)[:-1], None), (wrong(thirteen(7)), None),
            *[(ten(n), thirteen(n)) for n in (5, 8, 14_142_135)], (ten(TEN_X).lower(), thirteen(TEN_X)),
            ("X" + ten(TEN_X)[:-1], None), (wrong(ten(5)), None), ("word", None), ("", None), (None, None),
        ],
    ),
    "isbn10": (
        identifiers.normalize_isbn10,
        [*[(dashed(ten(n)), ten(n)) for n in (5, 8, TEN_X)], (wrong(ten(8)), None), (ten(8)[:5], None), (thirteen(8), None)],
    ),
    "doi": (
        identifiers.normalize_doi,
        [
            *[(before + "10.55555/Shelf_9(b)" + after, "10.55555/Shelf_9(b)")
              for before in ("", "DOI:", "https://dx.doi.org/", "http://doi.org/", "info:doi/") for after in ("", ".")],
            ("9.55555/x", None), ("10.shelf/x", None), ("10.55555/", None), ("10.55555/two words", None), (None, None),
        ],
    ),
    "language": (
        languages.normalize_language,
        [
            ("German", "deu"), ("de", "deu"), ("ger", "deu"), ("en-us", "eng"), ("pt_BR", "por"),
            ("xyz", "xyz"), ("d", None), ("dothraki-ish", None), ("", None), (None, None), ("Français", "fra"),
        ],
    ),
    "extension": (
        fields.normalize_extension,
        [("DjVu", "djvu"), (".cbz", "cbz"), ("\tfb2 ", "fb2"), ("q" * 10, "q" * 10), ("q" * 11, None), ("cb z", None),
         ("/x", None), (".", None), ("", None), (None, None)],
    ),
    "year": (
        fields.normalize_year,
        [("2020", 2020), ("in 1999", 1999), ("2008:05:06", 2008), ("99", None), ("19991", 1999),
         ("0999 2001", None), ("٢٠٠١", 2001), (None, None)],
    ),
    "series_position": (
        fields.normalize_series_position,
        [("5", 5), ("012", 12), ("32767", 32767), ("32768", None), ("-3", None), ("0", None), ("abc", None),
         ("", None), (None, None)],
    ),
    "authors": (
        fields.split_authors,
        [
            ("West, A; Doe, B", ["West, A", "Doe, B"]), ("J Smith and K Doe", ["J Smith", "K Doe"]),
            ("Jaeger, W", ["Jaeger, W"]), ("A | B & C , D;", ["A", "B", "C", "D"]), ("Anderson", ["Anderson"]),
            ("", []), (None, []),
        ],
    ),
    "record_timestamp": (
        identifiers.record_timestamp,
        [("a__20240102T030405Z__x", dt.datetime(2024, 1, 2, 3, 4, 5)), ("a__20241302T030405Z__x", None),
         ("a", None), (None, None)],
    ),
    "upload_group": (
        identifiers.upload_group,
        [("aacid__upload_records_a_b__20240627T210539Z__1__H", "a_b"),
         ("aacid__upload_records__20240627T210539Z__1__H", None), (None, None)],
    ),
    "path_suffix": (
        text.path_suffix,
        [("a/b.tar.gz", ".gz"), ("a.b/c", ""), (".bashrc", ""), ("x.pdf/", ".pdf"), ("", "")],
    ),
    "title_from_path": (
        text.title_from_path,
        [("a/My_Book--two.epub", "My Book two"), (".bashrc", "bashrc"), ("x", "x"), ("", "")],
    ),
    "synthetic": (
        lambda c: identifiers.synthetic_md5("libby_records", c),
        [("", None), (" ", None), (None, None)],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    fn, cases = CASES[name]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    got = {r["i"]: r["v"] for r in df.select("i", fn(F.col("s")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_normal_form_on_random_text(spark):
    rng = random.Random(2)
    ranges = [(32, 0x250), (0x250, 0xD7FF), (0xAC00, 0xD7A3), (0xE000, 0x2FFFF)]
    pool = [chr(rng.randrange(*rng.choice(ranges))) for _ in range(2000)] + [" ", "\n", "ß", "é", "\x1c"]
    texts = ["".join(rng.choices(pool, k=15)) for _ in range(1500)]

    def expected(s):
        plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return " ".join(plain.split()).casefold()

    df = spark.createDataFrame([(s,) for s in texts], "s string")
    for r in df.select("s", text.normalize_text(F.col("s")).alias("n")).collect():
        assert r["n"] == expected(r["s"])


def test_isbn_lists(spark):
    lists = [
        (["no isbn", dashed(thirteen(77))], [thirteen(77)], []),
        ([ten(78), thirteen(79), ten(78), thirteen(78)], [thirteen(78), thirteen(79)], []),
        ([wrong(ten(80)), None, ""], [], []),
        (None, [], []),
    ]
    df = spark.createDataFrame([(n, v) for n, (v, _, _) in enumerate(lists)], "n int, v array<string>")
    rows = df.select("n", identifiers.isbn13_list(F.col("v")).alias("a"), identifiers.isbn10_list(F.col("v")).alias("b"))
    assert {r["n"]: (r["a"], r["b"]) for r in rows.collect()} == {n: (a, b) for n, (_, a, b) in enumerate(lists)}


def test_scalar_or_list(spark):
    lines = ['["", " x ", "y"]', '" x "', '"[1984]"', "5", "null", "[]"]
    df = spark.createDataFrame([(f'{{"v":{v}}}',) for v in lines], "j string").select(
        F.try_variant_get(F.parse_json("j"), "$.v", "variant").alias("v")
    )
    rows = df.select(text.as_list(F.col("v")).alias("l"), text.as_text(F.col("v")).alias("t")).collect()
    assert [r["l"] for r in rows] == [["x", "y"], ["x"], ["[1984]"], ["5"], [], []]
    assert [r["t"] for r in rows] == ["x", "x", "[1984]", "5", None, None]


def test_work_key_priority(spark):
    df = spark.createDataFrame(
        [(["1"], ["2"], ["3"], ["4"]), ([], ["2"], ["3"], ["4"]), ([], [], ["3"], ["4"]), ([], [], [], ["4"]),
         ([], [], [], [])],
        "a array<string>, b array<string>, c array<string>, d array<string>",
    )
    rows = df.select(identifiers.work_key(*[F.col(c) for c in "abcd"]).alias("k")).collect()
    assert [r["k"] for r in rows] == ["isbn:1", "isbn:2", "doi:3", "ol:4", None]


def test_counter_maps(spark):
    df = spark.sql("select map('a', 1L, 'b', 2L) l, map('b', 5L, 'c', 7L) r")
    row = df.select(maps.add_counters(F.col("l"), F.col("r")).alias("s"), maps.overlay(F.col("l"), F.col("r")).alias("o"))
    assert row.first().asDict() == {"s": {"a": 1, "b": 7, "c": 7}, "o": {"a": 1, "b": 5, "c": 7}}


def test_single_spaces_are_not_matches_of_the_normal_form(spark):
    """No pattern of the normal form matches one space, each match of which would be copied."""
    from shelfmark.functions.text import normalize_text

    texts = [("  A\tB \x1c\n c  d e",), ("É\u00a0 \tß  x y",)]
    df = spark.createDataFrame(texts, "t string").select(normalize_text(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == ["a b c d e", "e ss x y"]
    assert r"[\t-\r\x1C-\x20]+" not in df._jdf.queryExecution().optimizedPlan().toString()
