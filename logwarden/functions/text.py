"""Text expressions: whitespace handling and the masking patterns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Unicode text treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Trim Unicode whitespace on both sides (``trim`` alone removes only spaces)."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")


@dataclass(frozen=True)
class Mask:
    """One masking step.

    ``needs`` is a cheap necessary condition on (text, has_digit): when it is
    false the pattern cannot match, so the regex is not run for that row.
    """

    name: str
    label: str
    pattern: str
    needs: Callable[[Column, Column], Column] | None = None


# Masking patterns, in order of application. They are written for
# Java with (?U), so that \d \w \b \s follow Unicode; S is whitespace including
# the four separator controls \s leaves out.
S = r"[\s\x1c-\x1f]"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
HEX = "[0-9a-f]"
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
PATH_CHAR = r"[A-Za-z0-9_.\-]"
SIZE_UNITS = "KiB|MiB|GiB|TiB|KB|MB|GB|TB|B"
DURATION_UNITS = "μs|µs|us|ms|[smhd]|min|sec|millis|micros"
NUMERIC_KEYS = (
    "user_?id|uid|pid|tid|txn_?id|order_?id|session_?id|batch_?id|request_?id|req_?id|"
    "job_?id|task_?id|conn_?id|attempt|count|code|line|exit|status_code|fd"
)
#: What every one of these keys ends in.
KEY_ENDS = "id|attempt|count|code|line|exit|fd"
DIGIT = r"(?U)\d"

MASKS = (
    Mask(
        "iso_timestamp",
        "<TIMESTAMP>",
        r"(?iU)\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?\b",
        lambda t, digit: digit & t.contains("-") & t.contains(":"),
    ),
    Mask(
        "syslog_timestamp",
        "<TIMESTAMP>",
        rf"(?iU)\b(?:{MONTHS})[ ]\d{{1,2}}[ ]\d{{2}}:\d{{2}}:\d{{2}}\b"
        rf"|\d{{1,2}}/(?:{MONTHS})/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}(?:{S}[+-]\d{{4}})?",
        lambda t, digit: digit & t.contains(":"),
    ),
    Mask(
        "uuid",
        "<UUID>",
        rf"(?iU)\{{?{HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}\}}?",
        lambda t, digit: t.contains("-"),
    ),
    Mask(
        "ipv6",
        "<IPV6>",
        rf"(?iU)\b(?:(?:{HEX}{{1,4}}:){{7}}{HEX}{{1,4}}"
        rf"|(?:{HEX}{{1,4}}:)*:(?::{HEX}{{1,4}})*"
        r"|::ffff:[0-9]{1,3}(?:\.[0-9]{1,3}){3})\b",
        lambda t, digit: t.contains(":"),
    ),
    Mask(
        "ipv4",
        "<IP>",
        rf"(?U)\b(?:{OCTET}\.){{3}}{OCTET}(?:/\d{{1,2}})?\b",
        lambda t, digit: digit & t.contains("."),
    ),
    Mask(
        "url",
        "<URL>",
        r"""(?U)https?://[^\s\x1c-\x1f"'>)}{,;|]+""",
        lambda t, digit: t.contains("://"),
    ),
    Mask(
        "email",
        "<EMAIL>",
        r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
        lambda t, digit: t.contains("@"),
    ),
    Mask(
        "path",
        "<PATH>",
        rf"(?U)(?<![\w])(?:/{PATH_CHAR}+)+(?:/{PATH_CHAR}*)?",
        lambda t, digit: t.contains("/"),
    ),
    Mask(
        "size",
        "<SIZE>",
        rf"(?iU)\b\d+(?:\.\d+)?{S}*(?:{SIZE_UNITS})\b",
        lambda t, digit: digit,
    ),
    Mask(
        "duration",
        "<DURATION>",
        rf"(?iU)\b\d+(?:\.\d+)?{S}*(?:{DURATION_UNITS})\b",
        lambda t, digit: digit,
    ),
    Mask(
        "port",
        "port=<PORT>",
        r"(?iU)(?:port[=:\s\x1c-\x1f]+)(\d{1,5})\b",
        lambda t, digit: digit,
    ),
    Mask("hex_hash", "<HEX_HASH>", rf"(?iU)\b{HEX}{{16,64}}\b"),
    Mask(
        "hex_id",
        "<HEX_ID>",
        rf"(?iU)(?<![_A-Za-z])(?:0x){HEX}{{1,15}}\b|(?<![_A-Za-z])\b{HEX}{{8,15}}\b",
        lambda t, digit: t.rlike(rf"(?iU)0x|{HEX}{{8}}"),
    ),
    Mask(
        "epoch",
        "<TIMESTAMP>",
        r"(?U)(?<!\d)\d{10,13}(?!\d)",
        lambda t, digit: digit,
    ),
    Mask(
        "percentage",
        "<PCT>",
        r"(?U)\b\d+(?:\.\d+)?%",
        lambda t, digit: digit & t.contains("%"),
    ),
    Mask(
        "numeric_id",
        "<NUM_ID>",
        rf"(?iU)(?:(?:{NUMERIC_KEYS})[=:\s\x1c-\x1f]+\d+|\b\d{{6,}}\b)",
        lambda t, digit: digit
        & t.rlike(r"(?U)[=:\s\x1c-\x1f]\d|\d{6}")
        & t.rlike(rf"(?iU)(?:{KEY_ENDS})[=:\s\x1c-\x1f]+\d|\d{{6}}"),
    ),
)
MASK_BY_NAME = {mask.name: mask for mask in MASKS}


def collapse_spaces(col: Column) -> Column:
    """Runs of two or more spaces become one, then both ends are stripped."""
    squeezed = F.when(col.contains("  "), F.regexp_replace(col, " {2,}", " ")).otherwise(col)
    return strip(squeezed)
