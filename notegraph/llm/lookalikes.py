"""Text that looks the same but differs in its characters: one consistent spelling by script sets."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.looks import Looks, looks, text_udf

#: Scripts preferred, in this order, when a token can be spelled in several.
PREFERRED = ("Latin", "Cyrillic", "Greek", "Armenian")
#: UTS 39: scripts that are written together resolve to the writing systems that hold them.
AUGMENTED = {"Han": ("Hanb", "Jpan", "Kore"), "Hiragana": ("Jpan",), "Katakana": ("Jpan",), "Hangul": ("Kore",), "Bopomofo": ("Hanb",)}
#: Characters of these belong to every script.
ANY = frozenset(("Common", "Inherited"))
#: Tasks over which the ids of a spelling are spread when they are paired: as many as keep the ids of
#: one task under SPREAD_ROWS even if all have the same spelling.
LEAST_SALTS, SPREAD_ROWS = 16, 500_000
_LETTERS = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_ascii = re.compile(r"[\x20-\x7e]*\Z").match


def _ranges(pattern: str) -> list[tuple[int, int]]:
    """First and last code point of the ranges of an escaped set pattern."""
    at, dash = 1, False
    out: list[tuple[int, int]] = []
    while at < len(pattern) - 1:
        c = pattern[at]
        if c == "-":
            dash, at = True, at + 1
            continue
        if c == "\\":
            width = {"u": 4, "U": 8}.get(pattern[at + 1], 0)
            point, at = (int(pattern[at + 2 : at + 2 + width], 16), at + 2 + width) if width else (ord(pattern[at + 1]), at + 2)
        else:
            point, at = ord(c), at + 1
        if dash:
            out[-1] = (out[-1][0], point)
            dash = False
        else:
            out.append((point, point))
    return out


def script_ranges(spark: SparkSession) -> list[tuple[int, int, str]]:
    """(first, last, script) of all ranges of Script_Extensions that ICU knows; some thousands, whatever the data."""
    icu = spark._jvm.com.ibm.icu
    out = []
    for code in range(icu.lang.UScript.CODE_LIMIT):
        name = icu.lang.UScript.getName(code)
        # a copy is written out in ranges, the set itself as it was asked for
        pattern = icu.text.UnicodeSet().addAll(icu.text.UnicodeSet(f"[:scx={name}:]")).toPattern(True) if name and name != "Unknown" else "[]"
        out += [(a, b, name) for a, b in _ranges(pattern)]
    return out


class ScriptSets:
    """The script sets of characters (Script_Extensions)."""

    def __init__(self, ranges: list[tuple[int, int, str]]) -> None:
        self.ranges = ranges
        cuts = sorted({a for a, _, _ in ranges} | {b + 1 for _, b, _ in ranges})
        sets: list[set[str]] = [set() for _ in cuts]
        for a, b, name in ranges:
            for k in range(bisect_right(cuts, a) - 1, bisect_right(cuts, b)):
                sets[k].add(name)
        self.cuts, self.sets = cuts, [frozenset(x) for x in sets]

    def of(self, ch: str) -> frozenset[str]:
        at = bisect_right(self.cuts, ord(ch)) - 1
        return self.sets[at] if at >= 0 else frozenset()


class Spelling:
    """Brings values to their consistent spelling; picklable, one for each Python worker."""

    def __init__(self, shown: Looks, ranges: list[tuple[int, int, str]]) -> None:
        self.shown, self.scripts = shown, ScriptSets(ranges)
        self.spell: dict[str, dict[str, str]] = {}
        for cp, to in sorted(shown.alike.items()):
            own = self.spell.setdefault(to, {s: to for s in self.scripts.of(to)})
            for s in self.scripts.of(chr(cp)):
                own.setdefault(s, chr(cp))
        self._token = lru_cache(65536)(self._respell)
        self._resolved = lru_cache(65536)(self._resolve)

    def __reduce__(self):
        return Spelling, (self.shown, self.scripts.ranges)

    def _resolve(self, ch: str) -> frozenset[str] | None:
        """The resolved script set of a letter; None: every script."""
        own = self.scripts.of(ch)
        return None if own & ANY else own.union(*(AUGMENTED.get(s, ()) for s in own))

    def resolved(self, token: str) -> set[str] | None:
        """Intersection of the resolved script sets of a token; empty: it mixes scripts; None: every script."""
        common = None
        for ch in token:
            own = None if unicodedata.combining(ch) else self._resolved(ch)
            if own is not None:
                common = set(own) if common is None else common & own
        return common

    def _respell(self, token: str) -> str:
        """Spell a token of representatives in the one script in which all its letters can be spelled."""
        common = None
        for ch in token:
            if not unicodedata.combining(ch):
                own = self.spell.get(ch) or self.scripts.of(ch)
                if not ANY & set(own):
                    common = set(own) if common is None else common & set(own)
        if not common or "Latin" in common:
            return token
        to = min(common, key=lambda s: (PREFERRED.index(s) if s in PREFERRED else len(PREFERRED), s))
        return "".join(ch if unicodedata.combining(ch) else self.spell.get(ch, {}).get(to, ch) for ch in token)

    def form(self, text: str) -> str:
        if _ascii(text):
            return text.strip(" ")
        shown = self.shown.decomposed(text).translate(self.shown.alike)
        return unicodedata.normalize("NFC", _LETTERS.sub(lambda m: self._token(m[0]), shown)).strip(" ")

    def kind(self, text: str) -> str:
        """none, mixed-script or whole-script: how the letters of the worst token were disguised."""
        worst = "none"
        for token in _LETTERS.findall(self.shown.decomposed(text)):
            if self._token(token.translate(self.shown.alike)) == token:
                continue
            own = self.resolved(token)
            if own is not None and not own:
                return "mixed-script"
            worst = "whole-script"
        return worst


_cache: dict[str, Spelling] = {}


def spelling(spark: SparkSession) -> Spelling:
    """The speller of this session (its tables are derived once)."""
    app = spark.sparkContext.applicationId
    if app not in _cache:
        _cache[app] = Spelling(looks(spark), script_ranges(spark))
    return _cache[app]


def consistent_form(spark: SparkSession, text: Column) -> Column:
    """The consistent spelling of a column; plain ASCII never leaves the JVM, null stays null."""
    state = spark.sparkContext.broadcast(spelling(spark))  # Unicode's tables, some thousands of ranges
    plain = text.rlike(r"\A[\x20-\x7e]*\z")
    return F.when(plain, F.trim(text)).otherwise(text_udf(lambda: state.value.form)(F.when(~plain, text)))


def confusable_kind(spark: SparkSession, text: Column) -> Column:
    """none, mixed-script or whole-script; null for null."""
    state = spark.sparkContext.broadcast(spelling(spark))
    plain = text.rlike(r"\A[\x20-\x7e]*\z")
    return F.when(plain, F.lit("none")).otherwise(text_udf(lambda: state.value.kind)(F.when(~plain, text)))


def consistent_forms(values: DataFrame) -> DataFrame:
    """value, form, kind for each distinct non-null value.

    form is the one consistent spelling: widths, joined letters, blanks, hyphens, accents and
    invisible characters normalised, and every token spelled in the one script its letters share
    (the intersection of the scripts they can be spelled in; Latin if it is among several). kind
    tells how the value's letters were disguised: none, mixed-script (the resolved script sets of a
    token don't intersect) or whole-script. An empty table gives no rows, the empty string is its
    own form, long texts are taken whole, other columns are ignored.
    """
    spark = values.sparkSession
    v = values.select("value").filter("value IS NOT NULL").distinct()
    return v.select("value", consistent_form(spark, F.col("value")).alias("form"), confusable_kind(spark, F.col("value")).alias("kind"))


def differing_spellings(left: DataFrame, right: DataFrame) -> DataFrame:
    """value_a, value_b: spellings of `left` and `right` (columns value, form) that look the same and differ.

    Only distinct spellings meet, and only in forms that have more than one; so the rows of a
    popular text are never paired with each other. Repeated rows of `left` or `right` are the
    caller's to drop; null values and forms pair with nothing.
    """
    both = left.select("form", "value").unionByName(right.select("form", "value"))
    several = both.groupBy("form").agg((F.min("value") < F.max("value")).alias("s")).filter("s").select("form")
    a = left.select("form", F.col("value").alias("value_a")).join(several, "form", "left_semi")
    b = right.select("form", F.col("value").alias("value_b"))
    return a.join(b, "form").filter("value_a <> value_b").select("value_a", "value_b")


def expand(pairs: DataFrame, left: DataFrame, right: DataFrame, rows: int = 0) -> DataFrame:
    """a, b: the ids that carry the two spellings of a pair. left, right: id, value, without repeats.

    A popular spelling is spread over many tasks by id; its few pairs are repeated for them. rows:
    of the larger side, if known.
    """
    salts = max(LEAST_SALTS, -(-rows // SPREAD_ROWS))
    salted = lambda ids, side: ids.select(F.col("id").alias(side), F.col("value").alias(f"value_{side}"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    first = pairs.withColumn("salt", every).join(salted(left, "a"), ["value_a", "salt"]).select("a", "value_b")
    return first.withColumn("salt", every).join(salted(right, "b"), ["value_b", "salt"]).select("a", "b")
