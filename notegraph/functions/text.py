"""Parsing of markdown notes as column expressions; all stay in the JVM but nfc and casefold."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegraph.functions.looks import link_part

#: How frontmatter, fences, inline code, links and tags are written.
_ASCII = r"\A\p{ASCII}*\z"
_FM = r"\A---\n(?s:(.*?))\n---\n?"
_HAS_FM = r"\A---\n(?s:.*?)\n---"
FENCE_LINE = r"(?md)^[ \t]*(?:```|~~~)[^\n]*"
INLINE = r"`[^`\n]*`"
LINK = r"(?<!\\)!?\[\[([^\[\]]+)\]\]"
BODY_TAG = r"(?U)(?<![^\s])#([\p{L}\p{N}_/-]+)"


def _python(kind: str, text: Column) -> Column:
    import pyarrow as pa

    def run(values: pa.Array) -> pa.Array:
        to = (lambda v: unicodedata.normalize("NFC", v)) if kind == "nfc" else str.casefold
        return pa.array([None if v is None else to(v) for v in values.to_pylist()], pa.string())

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    plain = text.rlike(_ASCII)
    return F.when(plain, text if kind == "nfc" else F.lower(text)).otherwise(F.arrow_udf(run, "string")(F.when(~plain, text)))


def nfc(text: Column) -> Column:
    """Unicode NFC; the Python side sees only values that are not plain ASCII."""
    return _python("nfc", text)


def casefold(text: Column) -> Column:
    """Full case folding, where ß and ss are one."""
    return _python("casefold", text)


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def frontmatter(text: Column) -> Column:
    """The text between the --- fences at the start; null without."""
    return F.when(text.rlike(_HAS_FM), F.regexp_extract(text, _FM, 1))


def body(text: Column) -> Column:
    """The text after the frontmatter; all of it without."""
    return F.when(text.rlike(_HAS_FM), F.regexp_replace(text, _FM, "")).otherwise(text)


def fm_get(fm: Column, key: str) -> Column:
    """The value on the first line `key: value`, unquoted; null without one."""
    line = rf"(?md)^\Q{key}\E:[ \t]*(.+)$"
    return F.when(fm.rlike(line), F.btrim(strip(F.regexp_extract(fm, line, 1)), F.lit("\"'")))


def fm_list(fm: Column, key: str) -> Column:
    """The items of a block list; an empty array for a missing key, an inline value or no items."""
    block = F.regexp_extract(fm, rf"(?md)^\Q{key}\E:[ \t]*\n((?:[ \t]+-[ \t].*\n?)+)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x != "")

    def item(line: Column) -> Column:
        value = F.btrim(strip(F.substring(strip(line), 2, 1 << 30)), F.lit("\"'"))
        inner = r"\A\[\[(?s:(.*))\]\]\z"
        return F.when(value.rlike(inner), F.regexp_extract(value, inner, 1)).otherwise(value)

    return F.coalesce(F.transform(lines, item), F.array().cast("array<string>"))


def link_target(raw: Column) -> Column:
    """What a link points at: up to the first \\|, |, # or ^, stripped."""
    return link_part(raw)


def strip_code(text: Column) -> Column:
    """The text without code: fenced blocks become empty lines, inline code goes; lines stay in place.

    The text is split at its fence lines; of the pieces, every second one is code.
    """
    pieces = F.split(text, FENCE_LINE)
    kept = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, INLINE, "")).otherwise(F.regexp_replace(x, r"[^\n]+", "")))
    return F.when(text.contains("`") | text.contains("~~~"), F.array_join(kept, "")).otherwise(text)


def links(body_text: Column) -> Column:
    """Targets of the wikilinks outside code, in order, repeats kept, empty ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(strip_code(body_text), F.lit(LINK), F.lit(1)), link_target), lambda x: x != "")


def body_tags(body_text: Column) -> Column:
    """Words after # outside code that have a letter."""
    return F.filter(F.regexp_extract_all(strip_code(body_text), F.lit(BODY_TAG), F.lit(1)), lambda x: x.rlike(r"\p{L}"))


def is_iso_date(value: Column) -> Column:
    """A calendar date in one of the ISO 8601 forms 2026-08-10, 20260810, 2026-W33, 2026-W33-1 (and 2026W331)."""
    year = F.substring(value, 1, 4)
    plain = value.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()
    basic = value.rlike(r"\A\d{8}\z") & F.try_to_date(value, "yyyyMMdd").isNotNull()
    week_form = r"\A(\d{4})(?:-W(\d{2})(?:-([1-7]))?|W(\d{2})([1-7])?)\z"
    week = F.concat(F.regexp_extract(value, week_form, 2), F.regexp_extract(value, week_form, 4)).try_cast("int")
    last = F.weekofyear(F.try_to_date(F.concat(year, F.lit("-12-28")), "yyyy-MM-dd"))
    weeks = value.rlike(week_form) & week.between(1, last)
    return F.coalesce((plain | basic | weeks) & (year != "0000"), F.lit(False))


def path_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md\z", "")


def path_zone(path: Column) -> Column:
    """The first part of the path; for a note at the root that is its file name."""
    return F.element_at(F.split(path, "/"), 1)


def path_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(?s:(.*))/[^/]*\z", 1)


def is_note(path: Column) -> Column:
    return path.endswith(".md")


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda c: c.startswith("."))


def under(path: Column, zones: list[str]) -> Column:
    """The path is one of the zones or lies below one: at a slash, never a bare prefix."""
    out = F.lit(False)
    for z in zones:
        out = out | (path == z) | path.startswith(z + "/")
    return out
