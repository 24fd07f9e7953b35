"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A latin word with joins, a number with decimals and percent sign, or a run of CJK characters.
TOKEN = r"[A-Za-z]+(?:[._+\-]?[A-Za-z0-9]+)*|[0-9]+(?:\.[0-9]+)*(?:%|％)?|[\x{3400}-\x{9fff}]+"
CJK = r"^[\x{3400}-\x{9fff}]"
_TOKEN, _CJK = (re.compile(re.sub(r"\\x\{(\w+)\}", r"\\u\1", p)) for p in (TOKEN, CJK[1:]))
# Page tokens in repeated margins, the whole-answer refusal, citations.
ROMAN = r"(?i)(?<![A-Za-z])[ivxlcdm]+(?![A-Za-z])"
ARABIC = r"(?<![A-Za-z0-9])[0-9]+(?![A-Za-z0-9])"
REFUSAL = r"^资料中没有找到相关内容[。.!！]?(?:\s*\[[0-9]+\])*\s*$"
CITATION = r"\[([0-9]+)\]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case words and numbers; CJK runs as overlapping pairs, a single character as itself."""

    def pieces(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(CJK), pairs).otherwise(F.array(F.lower(run)))

    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.when(text.rlike(CJK[1:]), F.flatten(F.transform(found, pieces))).otherwise(F.transform(found, F.lower))


def words(text: str) -> list[str]:
    """The same as ``tokens`` in plain Python."""
    found = _TOKEN.findall(text)
    if not _CJK.search(text):
        return [x.lower() for x in found]
    return [w for x in found for w in ([x[i : i + 2] for i in range(max(len(x) - 1, 1))] if _CJK.match(x) else [x.lower()])]


def normalized(text: Column) -> Column:
    """Stripped text whose lines are stripped and have single blanks; line breaks stay."""
    lines = F.split(strip(text), r"\R")
    return F.array_join(F.transform(lines, lambda x: strip(F.regexp_replace(x, "[ \t]+", " "))), "\n")


def repeat_key(text: Column) -> Column:
    """What is compared between pages: one blank for white space, lower case, page numbers as <PAGE>."""
    plain = F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))
    return F.regexp_replace(F.regexp_replace(plain, ROMAN, "<PAGE>"), ARABIC, "<PAGE>")


def html_text(html: Column) -> Column:
    """Rows of tables on lines of their own, cells parted by bars, other tags dropped, common entities decoded."""
    for pattern, into in ((r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", ""), (r"(?i)<tr\b[^>]*>", "\n"), (r"(?i)<t[dh]\b[^>]*>", " | "), (r"(?i)<br\s*/?>", " "), (r"<[^>]*>", "")):
        html = F.regexp_replace(html, pattern, into)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    return strip(html)


def csv_guard(value: Column) -> Column:
    """Spreadsheet formulas defused by a leading apostrophe."""
    return F.when(value.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def percent(value: Column) -> Column:
    """One decimal and a percent sign; blank for null."""
    return F.when(value.isNotNull(), F.format_string("%.1f%%", value.cast("double") * 100)).otherwise("")


def seconds(value: Column) -> Column:
    """Two decimals and the unit; blank for null."""
    return F.when(value.isNotNull(), F.format_string("%.2fs", value.cast("double"))).otherwise("")


def iso_time(value: Column) -> Column:
    """A timestamp as text in UTC with microseconds."""
    utc = F.to_utc_timestamp(value, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def slug(text: Column, length: int = 24) -> Column:
    """A text as part of a file name: runs of other characters than letters, digits and CJK become one dash."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[^0-9A-Za-z\x{3400}-\x{9fff}]+", "-"), "^-+|-+$", "")
    return F.when(plain == "", "query").otherwise(F.left(plain, F.lit(length)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def host(url: Column) -> Column:
    """The host of an address in lower case, null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def merged_maps(first: Column, second: Column) -> Column:
    """Entries of both maps, those of the second where both have a key."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k)), second)


def without_keys(value: Column, keys: list[str]) -> Column:
    """The entries of a map but for some keys."""
    return F.map_filter(value, lambda k, v: ~k.isin(keys))


def counted(values: Column) -> Column:
    """A map of the distinct values of an array to how often they occur."""
    distinct = F.array_sort(F.array_distinct(values))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda d: F.size(F.filter(values, lambda v: v == d))))


def redact(text: Column) -> Column:
    """Bearer tokens and addresses of remote calls left out of messages."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)bearer\s+\S+", "Bearer <redacted>"), r"https?://\S+", "<url>")
