"""Cell cleaning, key normalisation and label sort keys as string Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.numeric import as_column, num

# White space as the Unicode standard and the reference count it.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# What stands for an empty cell, and the shapes of numbers, times and dates.
EMPTY_CELL = r"(?iu)^(?:|[-—–]+|н/?д|n/?a|null)$"
NUMBER = r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TIME_ONLY = r"^\d{1,2}:\d{2}(:\d{2})?$"
ISO_DATE_START = r"^\d{4}-\d{2}-\d{2}"
DAY_FIRST_DATE_START = r"^\d{1,2}[./]\d{1,2}[./]\d{4}"
DAY_FIRST_DATE = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?$"
# Numbers of this size and above are codes or phone numbers and stay text.
CODE_SIZED = 1e12


# The same white space as single characters.
SPACE_CHARACTERS = (
    " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_all(c: Column | str) -> Column:
    return F.btrim(as_column(c).cast("string"), F.lit(SPACE_CHARACTERS))


def point_decimal(c: Column) -> Column:
    """Drop the spaces and turn the first comma into a point."""
    packed = F.regexp_replace(c, f"{SPACE}+", "")
    return F.regexp_replace(packed, r"^([^,]*),", "$1.")


def parse_date_text(c: Column | str) -> Column:
    """ISO text of a date cell, null if it is none.

    Takes an ISO start, or day first with points or slashes and an optional time.
    Days that are not in the calendar are no dates; a time alone is none either.
    """
    return _date_of(trim_all(c))


def parse_number_text(c: Column | str) -> Column:
    """Double of a number written with a point or comma and spaces between thousands, else null."""
    return _number_of(point_decimal(trim_all(c)))


def _date_of(trimmed: Column) -> Column:
    iso = F.substring_index(trimmed, "T", 1)
    iso_day = F.left(iso, F.lit(10)).try_cast("date")
    day_first = F.regexp_replace(trimmed, DAY_FIRST_DATE, "$3-$2-$1").try_cast("date")
    return F.when(trimmed.rlike(ISO_DATE_START), F.when(iso_day.isNotNull(), iso)).when(
        trimmed.rlike(DAY_FIRST_DATE) & (F.year(day_first) >= 100), day_first.cast("string")
    )


def _number_of(packed: Column) -> Column:
    return F.when(packed.rlike(NUMBER), num(packed))


def clean_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raw text columns as structs ``kind, text, number``.

    ``kind`` is ``date``, ``number`` or ``text`` and null for an empty cell; ``text``
    holds the ISO date, the canonical number or the trimmed text. Each step is a projection
    of its own, so that a cell is trimmed and parsed once and the generated code stays small.
    """
    return _typed_cells(df, columns, EMPTY_CELL, _date_of, CODE_SIZED)


def fetched_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns fetched as text as ``kind, text, number``: blank is null, numbers are parsed, dates are text."""
    return _typed_cells(df, columns, "^$", lambda _: F.lit(None).cast("string"), float("inf"))


def _typed_cells(df, columns, empty, date_of, number_limit) -> DataFrame:
    at = lambda step, n: F.col(f"`__{step}_{n}`")
    names = [f"__{step}_{n}" for step in ("v", "p", "d", "n") for n in columns]
    trimmed = df.withColumns({f"__v_{n}": trim_all(n) for n in columns})
    packed = trimmed.withColumns({f"__p_{n}": point_decimal(at("v", n)) for n in columns})
    parsed = packed.withColumns(
        {f"__d_{n}": date_of(at("v", n)) for n in columns} | {f"__n_{n}": _number_of(at("p", n)) for n in columns}
    )

    def cell(n: str) -> Column:
        v, date, number = at("v", n), at("d", n), at("n", n)
        is_number = date.isNull() & (F.abs(number) < number_limit)
        filled = ~v.rlike(empty)
        kind = F.when(filled, F.when(date.isNotNull(), "date").when(is_number, "number").otherwise("text"))
        text = F.coalesce(date, F.when(is_number, at("p", n)), v)
        return F.struct(kind.alias("kind"), F.when(filled, text).alias("text"), F.when(is_number, number).alias("number"))

    return parsed.withColumns({n: cell(n) for n in columns}).drop(*names)


# Cyrillic letters written with more than one Latin letter.
MULTI_LETTER = {
    "ё": "yo", "ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya",
}
# Letters and separators written with one character, position by position.
SINGLE_FROM = "абвгдезийклмнопрстуфхыэ -"
SINGLE_TO = "abvgdeziyklmnoprstufhye__"


def transliterate(c: Column | str) -> Column:
    """ASCII alias of a heading: Latin letters, digits and single underscores."""
    v = F.lower(as_column(c))
    for letter, latin in MULTI_LETTER.items():
        v = F.replace(v, F.lit(letter), F.lit(latin))
    v = F.translate(v, SINGLE_FROM, SINGLE_TO)
    return F.regexp_replace(F.regexp_replace(v, "[^a-z0-9_]", ""), "_+", "_")


# Padded widths of numeric codes by normalisation mode.
KEY_WIDTHS = {"none": None, "lpad8": 8, "lpad11": 11}


def normalize_key(c: Column | str, mode: str = "none") -> Column:
    """Code in canonical form for a dictionary lookup: trimmed, without ``.0``, padded to the mode's width."""
    width = KEY_WIDTHS[mode]
    v = trim_all(F.coalesce(as_column(c).cast("string"), F.lit("")))
    v = F.regexp_replace(v, r"^(\d+)\.0$", "$1")
    if width is None:
        return v
    return F.when(v.rlike(r"^\d+$") & (F.length(v) < width), F.lpad(v, width, "0")).otherwise(v)


def natural_key(c: Column | str, locale: str = "ru") -> Column:
    """Sort key of labels: letters as the locale orders them, digit runs by value.

    Letters differ first, then accents, then case, each over the whole label: "ё" stands with "е", and "part 2" before
    "Part 10". A digit run is written behind its length, so it compares by value with other runs and as a digit with
    everything else; the rest is the locale's collation of the one text.
    """
    parts = F.regexp_extract_all(as_column(c), F.lit(r"(\d+|\D+)"), F.lit(1))

    def encode(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        return F.when(part.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(part)

    return F.collate(F.array_join(F.transform(parts, encode), ""), locale)
