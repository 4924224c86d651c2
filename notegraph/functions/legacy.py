"""The older reading of notes, kept for comparison; it differs from functions.text in details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegraph.functions.text import nfc, strip

#: Patterns of the older reading.
PLACEHOLDER = r"(?i)^(\{.*\}|\$\{.*\}|<.*>|.*\b(NN|XXX?|TODO|TBD)\b.*)$"
BAD_NAME = r"[`\[\]|#^\\/:*?\"<>]"
TEMPLATE_PATH = r"(^|/)(Templates|_Template)/|(^|/)_template\.md$"
LINK = r"(?<!\\)\[\[([^\[\]\n]+?)\]\]"
JUNK_TAG = r"((?<![\p{L}\p{N}_`\\])#(?=[\p{L}\p{N}_]*[a-zA-Z])[0-9a-zA-Z_-]{2,}(?![0-9a-zA-Z_/-]))"
NESTED_TAG = r"(?<![\p{L}\p{N}_`\\])#([A-Za-z가-힣][0-9a-zA-Z가-힣_-]*(?:/[0-9a-zA-Z가-힣_-]+)+)"


def fm_list(fm: Column, key: str) -> Column:
    """Items directly below `key:`; each pair of brackets is peeled alone."""
    block = F.regexp_extract(F.concat(F.coalesce(fm, F.lit("")), F.lit("\n")), rf"(?md)^\Q{key}\E:\n((?:[ \t]+- .*\n)+)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x != "")
    return F.transform(lines, lambda x: F.regexp_replace(F.btrim(strip(F.substring(strip(x), 3, 1 << 30)), F.lit("\"'")), r"^\[\[|\]\]$", ""))


def fm_blocks(fm: Column) -> Column:
    """array of (key, block): a line `key:` opens a block, other lines belong to the block before."""
    start = F.array().cast("array<struct<key:string,block:string>>")

    def step(acc: Column, line: Column) -> Column:
        head = line.rlike(r"^[\p{L}\p{N}_-]+:")
        new = F.struct(F.regexp_extract(line, r"^([\p{L}\p{N}_-]+):", 1).alias("key"), line.alias("block"))
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["key"].alias("key"), F.concat(last["block"], F.lit("\n"), line).alias("block"))
        kept = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(head, F.array_append(acc, new)).when(F.size(acc) == 0, acc).otherwise(F.array_append(kept, grown))

    return F.aggregate(F.split(F.coalesce(fm, F.lit("")), "\n"), start, step)


def strip_code(text: Column) -> Column:
    """Like text.strip_code, but a fence closes only with its own marker, after any white space."""
    start = F.struct(F.lit("").alias("marker"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        fence = F.regexp_extract(strip(line), r"^(```|~~~)", 1)
        marker = F.when((fence != "") & (acc["marker"] == ""), fence).when(fence == acc["marker"], "").otherwise(acc["marker"])
        marker = F.when(fence == "", acc["marker"]).otherwise(marker)
        kept = F.when((fence != "") | (acc["marker"] != ""), "").otherwise(F.regexp_replace(line, "`[^`\n]*`", ""))
        return F.struct(marker.alias("marker"), F.array_append(acc["out"], kept).alias("out"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: F.array_join(acc["out"], "\n"))


def link_target(raw: Column) -> Column:
    """Cut at the first separator, backslashes off the end, NFC."""
    cut = F.regexp_extract(raw, r"^((?s:.*?))(?:\\\||\||#|\^|\z)", 1)
    return nfc(strip(F.regexp_replace(cut, r"\\+\z", "")))


def raw_links(body: Column) -> Column:
    """Bodies of the wikilinks outside code, uncut; embeds count, links over lines don't."""
    return F.regexp_extract_all(strip_code(body), F.lit(LINK), F.lit(1))


def junk_tags(body: Column) -> Column:
    """Words that become tags unmeant, on lines that hold more than tags."""

    def of_line(line: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(line, r"\]\([^)]*\)", "]()"), r"(?U)https?://\S+", "")
        only_tags = strip(F.regexp_replace(s, "#[0-9a-zA-Z_/-]+", "")) == ""
        return F.when(only_tags, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(s, F.lit(JUNK_TAG), F.lit(1)))

    return F.flatten(F.transform(F.split(body, "\n"), of_line))


def nested_tags(body: Column) -> Column:
    """Tags in the body with at least one slash."""
    return F.regexp_extract_all(strip_code(body), F.lit(NESTED_TAG), F.lit(1))


def is_placeholder(target: Column) -> Column:
    return target.rlike(PLACEHOLDER)


def is_skill_ref(target: Column, skills: list[str]) -> Column:
    """One of the names, or a path from one whose last part begins with SKILL."""
    parts = F.split(nfc(target), "/")
    return nfc(target).isin(skills) | (F.element_at(parts, 1).isin(skills) & F.upper(F.element_at(parts, -1)).startswith("SKILL"))


def bad_name(title: Column) -> Column:
    return title.rlike(BAD_NAME)


def is_template(path: Column, fm: Column) -> Column:
    return F.coalesce(fm.rlike(r"(?md)^type:\s*template\s*$"), F.lit(False)) | path.rlike(TEMPLATE_PATH)


def routing_warning(path: Column, kind: Column, subdirs: dict[str, list[str]], zones: dict[str, list[str]]) -> Column:
    """The place whose usual types don't include `kind`; null where they do or none are known.

    A directory's rule comes before its zone's. Both tables are configuration.
    """
    first = F.element_at(F.split(path, "/"), 1)
    out = F.lit(None).cast("string")
    for zone, types in zones.items():
        out = F.when((first == zone) & ~kind.isin(types), F.lit(zone)).otherwise(out)
    for prefix, types in subdirs.items():
        out = F.when(path.startswith(prefix + "/"), F.when(~kind.isin(types), F.lit(prefix))).otherwise(out)
    return out
