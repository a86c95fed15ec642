"""Language names and codes to ISO 639-3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import strip

# Names and codes (ISO 639-1, 639-2 B/T, 639-3) and the ISO 639-3 code of each.
# fmt: off
LANGUAGE_CODES: dict[str, str] = {
    "de": "deu", "ger": "deu", "deu": "deu", "german": "deu", "deutsch": "deu",
    "en": "eng", "eng": "eng", "english": "eng",
    "fr": "fra", "fre": "fra", "fra": "fra", "french": "fra", "français": "fra", "franzosisch": "fra",
    "es": "spa", "spa": "spa", "spanish": "spa", "español": "spa", "spanisch": "spa",
    "it": "ita", "ita": "ita", "italian": "ita", "italienisch": "ita",
    "nl": "nld", "dut": "nld", "nld": "nld", "dutch": "nld", "niederlandisch": "nld",
    "ru": "rus", "rus": "rus", "russian": "rus", "russisch": "rus",
    "pt": "por", "por": "por", "portuguese": "por",
    "pl": "pol", "pol": "pol", "polish": "pol", "polnisch": "pol",
    "zh": "zho", "chi": "zho", "zho": "zho", "chinese": "zho", "mandarin": "zho",
    "ja": "jpn", "jpn": "jpn", "japanese": "jpn",
    "ko": "kor", "kor": "kor", "korean": "kor",
    "ar": "ara", "ara": "ara", "arabic": "ara",
    "tr": "tur", "tur": "tur", "turkish": "tur",
    "sv": "swe", "swe": "swe", "swedish": "swe",
    "no": "nor", "nor": "nor", "norwegian": "nor",
    "nob": "nob",
    "nno": "nno",
    "da": "dan", "dan": "dan", "danish": "dan",
    "fi": "fin", "fin": "fin", "finnish": "fin",
    "cs": "ces", "cze": "ces", "ces": "ces", "czech": "ces",
    "hu": "hun", "hun": "hun", "hungarian": "hun",
    "ro": "ron", "rum": "ron", "ron": "ron", "romanian": "ron",
    "el": "ell", "gre": "ell", "ell": "ell", "greek": "ell",
    "he": "heb", "heb": "heb", "hebrew": "heb",
    "hi": "hin", "hin": "hin", "hindi": "hin",
    "id": "ind", "ind": "ind", "indonesian": "ind",
    "uk": "ukr", "ukr": "ukr", "ukrainian": "ukr",
    "bg": "bul", "bul": "bul", "bulgarian": "bul",
    "hr": "hrv", "hrv": "hrv", "croatian": "hrv",
    "sr": "srp", "srp": "srp", "serbian": "srp",
    "sk": "slk", "slo": "slk", "slk": "slk", "slovak": "slk",
    "sl": "slv", "slv": "slv", "slovenian": "slv",
    "vi": "vie", "vie": "vie", "vietnamese": "vie",
    "th": "tha", "tha": "tha", "thai": "tha",
    "fa": "fas", "fas": "fas", "per": "fas", "persian": "fas", "farsi": "fas",
    "la": "lat", "lat": "lat", "latin": "lat",
    "mul": "mul", "multiple": "mul",
}
# fmt: on
REGION_FORM = r"^([a-z]{2,3})[-_]"
LIST_SEPARATORS = "[,;/]"


def _known(key: Column) -> Column:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in LANGUAGE_CODES.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def _name(c: Column) -> Column:
    return F.nullif(F.lower(strip(c)), F.lit(""))


def _code(name: Column) -> Column:
    base = F.nullif(F.regexp_extract(name, REGION_FORM, 1), F.lit(""))
    return F.coalesce(_known(name), _known(base), F.when(name.rlike(r"^\p{L}{3}$"), name))


def normalize_language(c: Column) -> Column:
    """ISO 639-3 code of a name or code, its base language, an unknown 3-letter code, or null."""
    return _code(_name(c))


def language_list(values: Column) -> Column:
    """Distinct codes of a list, order kept."""
    codes = F.filter(F.transform(F.transform(values, _name), _code), lambda x: x.isNotNull())
    return F.coalesce(F.array_distinct(codes), F.array().cast("array<string>"))


def language_list_of_text(c: Column) -> Column:
    """The same for one string with several names in it."""
    return language_list(F.split(c, LIST_SEPARATORS))


def one_language(code: Column) -> Column:
    """A list holding the code, empty when it is null."""
    return F.filter(F.array(code), lambda x: x.isNotNull())
