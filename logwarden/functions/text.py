"""Validation, sanitising and accessors over single columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ACTION_TYPES, LOG_TYPES, MAX_TEXT_BYTES, ORIGINS

# The Unicode White_Space characters.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
CONTROL_CHARS = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"


def text(c: Column | str) -> Column:
    """Null and blank are the same thing: missing."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def trim_text(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def sanitize_text(c: Column) -> Column:
    """Drop control characters, keep tab and newline."""
    return F.regexp_replace(c, CONTROL_CHARS, "")


def cut_bytes(c: Column, n: int) -> Column:
    """At most ``n`` bytes of UTF-8; a character cut in half becomes U+FFFD."""
    head = F.make_valid_utf8(F.substring(c.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(c) > n, head).otherwise(c)


def text_problem(c: Column, name: str, max_bytes: int = MAX_TEXT_BYTES) -> Column:
    """Why a text is refused, or null: length in bytes, encoding, NUL."""
    return (
        F.when(F.octet_length(c) > max_bytes, F.lit(f"sanitize({name}): exceeds max length {max_bytes}"))
        .when(~F.is_valid_utf8(c), F.lit(f"sanitize({name}): invalid UTF-8"))
        .when(F.contains(c, F.lit("\x00")), F.lit(f"sanitize({name}): contains null bytes"))
    )


def is_allowed_type(c: Column) -> Column:
    return F.coalesce(c.isin(*LOG_TYPES), F.lit(False))


def is_allowed_origin(c: Column) -> Column:
    return text(c).isin("", *ORIGINS)


def is_allowed_action(c: Column) -> Column:
    return F.coalesce(c.isin(*ACTION_TYPES), F.lit(False))


def tag_value(tags: Column, key: str, default: str) -> Column:
    """Value of the first tag with this key."""
    hit = F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))
    return F.coalesce(hit["category"], F.lit(default))


def first_resource(ids: Column, default: str) -> Column:
    return F.coalesce(F.get(ids, F.lit(0)), F.lit(default))


def actor_or(actor: Column, default: str) -> Column:
    return F.coalesce(F.nullif(actor, F.lit("")), F.lit(default))


def utc_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.fraction]`` in UTC, whatever the session time zone is."""
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    zero = F.lit(0)
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)).cast("string")


def utc_date(ts: Column) -> Column:
    """The day of an instant in UTC, whatever the session time zone is."""
    days = F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def rfc3339(ts: Column) -> Column:
    """Seconds precision, UTC: the form timestamps have inside stored text."""
    return F.concat(F.replace(F.substring(utc_text(ts), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))


def rfc3339_nano(ts: Column) -> Column:
    """Fractional seconds without trailing zeros."""
    return F.concat(F.replace(utc_text(ts), F.lit(" "), F.lit("T")), F.lit("Z"))


def json_text(js: Column) -> Column:
    """JSON with the characters <, >, & and the line separators escaped."""
    for ch, code in (("<", "003c"), (">", "003e"), ("&", "0026"), ("\u2028", "2028"), ("\u2029", "2029")):
        js = F.replace(js, F.lit(ch), F.lit("\\u" + code))
    return js
