"""Parsing of spreadsheet text as column expressions: a value that can't be read is null, never an exception."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of yes and no, names of months, patterns of dates, ZIPs and numbers.
TRUE_WORDS = ("true", "t", "yes", "y", "1", "x", "✓", "✔", "on")
FALSE_WORDS = ("false", "f", "no", "n", "0", "-", "off")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_NUMBERS = {m[:3]: i + 1 for i, m in enumerate(MONTHS)} | {m: i + 1 for i, m in enumerate(MONTHS)} | {"sept": 9}
ISO_DATE = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
NUMERIC_DATE = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2}|\d{4})$"
NAMED_DATE = r"^(\d{1,2})?\s*([a-z]{3,9})\.?\s*(\d{1,2})?,?\s*(\d{4})$"
ZIP = r"^[A-Za-z0-9][A-Za-z0-9 \-]{2,9}$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"


def clean(x: Column) -> Column:
    return F.lower(F.btrim(F.coalesce(x, F.lit("")), F.lit(" \t\n\x0b\f\r")))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is computed once however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def normalize_header(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def parse_bool(x: Column) -> Column:
    c = clean(x)
    return F.when(c.isin(*TRUE_WORDS), True).when(c.isin(*FALSE_WORDS), False)


def date_vote(x: Column) -> Column:
    """dmy or mdy where a part above 12 decides; null where it does not."""
    part = lambda i: F.regexp_extract(clean(x), NUMERIC_DATE, i).try_cast("int")
    return F.when(part(1) > 12, "dmy").when(part(2) > 12, "mdy")


def _first_vote(vote: Column, position: str) -> Column:
    return F.min_by(vote, F.when(vote.isNotNull(), F.col(position)))


def date_order(value: str, position: str) -> Column:
    """An aggregate: the order that the first deciding value gives; iso if the dates that there are need none, else ambiguous."""
    c = clean(F.col(value))
    numeric, written = F.bool_or(c.rlike(NUMERIC_DATE)), F.bool_or(c.rlike(ISO_DATE) | c.rlike(NAMED_DATE))
    return F.coalesce(_first_vote(date_vote(F.col(value)), position), F.when(~numeric & written, "iso").otherwise("ambiguous"))


def detect_date_order(rows: DataFrame, value: str, position: str) -> DataFrame:
    """One row: date_order."""
    return rows.agg(date_order(value, position).alias("date_order"))


def parse_date(x: Column, order: str) -> Column:
    """ISO, named-month and numeric dates; two-digit years from 70 on are of the last century."""
    month_of = F.create_map(*[F.lit(v) for pair in MONTH_NUMBERS.items() for v in pair])
    day, month = (0, 1) if order == "dmy" else (1, 0)
    dated = lambda y, m, d: F.concat(y, F.lit("-"), m, F.lit("-"), F.nullif(d, F.lit("")))
    full = lambda y: F.when(F.length(y) == 4, y).when(y < "70", F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))
    numeric = lambda p: dated(full(p[2]), p[month], p[day])

    def read(c: Column) -> Column:
        g = lambda i: F.regexp_extract(c, NAMED_DATE, i)
        named = dated(g(4), F.try_element_at(month_of, g(2)).cast("string"), F.coalesce(F.nullif(g(1), F.lit("")), g(3)))
        return F.when(c.rlike(NUMERIC_DATE), let(F.split(c, "[-/.]"), numeric)).when(c.rlike(ISO_DATE), F.translate(c, "/.", "--")).when(c.rlike(NAMED_DATE), named)

    return F.try_to_date(let(clean(x), read))


def amount(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[^0-9,.\-]+", "")


def decimal_vote(x: Column) -> Column:
    """dot or comma where a number's separators decide; a lone group of three digits does not."""
    c = amount(x)
    count = lambda s: F.length(c) - F.length(F.regexp_replace(c, s, ""))
    dots, commas = count(r"\."), count(",")
    after_last = lambda s: F.length(F.substring_index(c, s, -1))
    return (
        F.when((dots > 0) & (commas > 0), F.when(after_last(".") < after_last(","), "dot").otherwise("comma"))
        .when((dots == 1) & (after_last(".") != 3), "dot")
        .when((commas == 1) & (after_last(",") != 3), "comma")
        .when(dots > 1, "comma")
        .when(commas > 1, "dot")
    )


def decimal_style(value: str, position: str) -> Column:
    """An aggregate: the style that the first deciding amount gives; dot if none has a separator, else ambiguous."""
    any_separator = F.bool_or(amount(F.col(value)).rlike("[.,]"))
    return F.coalesce(_first_vote(decimal_vote(F.col(value)), position), F.when(any_separator, "ambiguous").otherwise("dot"))


def detect_decimal_style(rows: DataFrame, value: str, position: str) -> DataFrame:
    """One row: decimal_style."""
    return rows.agg(decimal_style(value, position).alias("decimal_style"))


def parse_money_cents(x: Column, style: str) -> Column:
    """Cents, half to even; null for blank, unreadable or negative amounts."""
    c = F.translate(amount(x), ",", "") if style == "dot" else F.translate(amount(x), ",.", ".")
    return let(_number(c), lambda v: F.when(v >= 0, F.bround(v * 100).cast("long")))


def _number(c: Column) -> Column:
    return let(c, lambda n: F.when(n.rlike(NUMBER), n.try_cast("double")))


def parse_int(x: Column) -> Column:
    """A whole number, cut toward zero; thousands may be grouped by commas."""
    return _number(F.translate(clean(x), ",", "")).try_cast("long")


def parse_hours(x: Column) -> Column:
    """``h:mm`` or a number with an optional unit, to four places."""
    clock = r"^(\d+):(\d{1,2})$"

    def read(c: Column) -> Column:
        hm = F.regexp_extract(c, clock, 1).try_cast("double") + F.regexp_extract(c, clock, 2).try_cast("double") / 60
        return F.when(c.rlike(clock), hm).otherwise(_number(F.trim(F.regexp_replace(c, r"(hrs?|hours?|h)$", ""))))

    return F.bround(let(F.translate(clean(x), ",", ""), read), 4)


def parse_list(x: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[;,|/]"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.slice(parts, 1, 20))


def normalize_zip(x: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(x, r"\s+", "")), F.lit(""))


def parse_text(x: Column, limit: int = 2000) -> Column:
    """Single blanks, trimmed, at most ``limit`` characters; null if nothing is left."""
    return let(F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, limit), lambda v: F.nullif(v, F.lit("")))


def parse_enum(x: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.lower(parse_text(x, 60)))


def parse_state(x: Column) -> Column:
    code = F.regexp_replace(F.upper(parse_text(x, 20)), r"\.", "")
    return F.when(code.rlike(r"^\p{L}{2}$"), code)


def parse_zip(x: Column) -> Column:
    code = parse_text(x, 12)
    return F.when(code.rlike(ZIP), F.upper(code))


def building_key(line1: Column, zip_code: Column) -> Column:
    """Street and ZIP in lower case, so that visits to one address meet; null without a street."""
    street = parse_text(line1, 300)
    return F.when(street.isNotNull(), F.substring(F.concat_ws("|", F.lower(street), F.lower(F.coalesce(parse_text(zip_code, 12), F.lit("")))), 1, 320))


def fingerprint(*fields: Column) -> Column:
    """sha-256 of the identifying fields as a JSON list; nulls keep their place, floats have two places."""
    return F.sha2(F.to_json(F.array(*(f.cast("string") for f in fields))), 256)
