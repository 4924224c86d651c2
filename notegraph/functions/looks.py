"""One key for text that reads the same on screen.

Two values have the same key when they differ only in the width of letters, in how accents are
stored, in invisible characters, in the kind of blank, hyphen or apostrophe, in joined letters, or
in the script that a look-alike letter is taken from. Letter case, the presence of an accent,
superscripts and circled figures are kept. Blanks at either end don't show and are dropped.

The table of look-alikes is not written down here: it is derived from the Unicode confusables that
ICU, a library in every Spark distribution, holds (UTS 39 skeletons). Comparing links by looks needs
no more; which script a text is best spelled in is not decided here.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Letters that ICU lists as confusable, with what they read like instead.
NOT_ALIKE = {
    "г": "a corner, not the r it is listed for", "σ": "a closed ring with a bar, not o", "α": "a loop with open ends, not a", "γ": "a fork below the line, not y",
    "ι": "has no dot, not i", "β": "has no gap at the foot, not ß", "ε": "two bows, not a barred c", "δ": "an own shape of its script", "ω": "an own shape of its script",
    "Ь": "a capital, listed for the small b", "ь": "a low bowl, not the tone sign it is listed for", "ҽ": "hooked, not e", "ӏ": "has no dot, not i",
    "ծ": "an own shape of its script", "գ": "its bar sticks out, not q", "զ": "its tail turns right, not q", "ց": "its bowl is open, not g", "ք": "crossed below the line, not f",
    "ռ": "its left stem reaches down, not n", "ա": "its last stem reaches down, not w",
}
#: Look-alikes inside the Latin script.
LATIN_ALIKE = {"ɡ": "g"}
#: What a single upright bar is depends on the reader (I, l, 1, |), so caseless letters listed for l are left alone.
BAR = "l"
#: Kinds of compatibility decomposition that change only width, joining or breaking.
WIDTH = frozenset(("<wide>", "<narrow>", "<noBreak>"))
_ascii = re.compile(r"[\x20-\x7e]*\Z").match


def _latin(ch: str) -> bool:
    return unicodedata.name(ch, "").startswith("LATIN ")


def _part_of_syllable(ch: str) -> bool:
    """Conjoining letters are parts of a syllable block, not letters that stand for themselves."""
    return 0x1100 <= ord(ch) <= 0x11FF or 0xA960 <= ord(ch) <= 0xA97F or 0xD7B0 <= ord(ch) <= 0xD7FF


def lookalikes(spark: SparkSession) -> tuple[dict[int, str], set[int]]:
    """Letter -> its representative among letters that look the same; and the invisible characters.

    Bounded by Unicode: some hundreds of letters and characters, whatever the data.
    """
    jvm = spark._jvm
    letters = [
        ch
        for ch in map(chr, range(0x80, 0x20000))
        if unicodedata.category(ch) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(ch) and not _latin(ch) and not _part_of_syllable(ch)
    ]
    prototypes = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    alike = {ord(a): b for a, b in LATIN_ALIKE.items()}
    for ch, proto in zip(letters, prototypes):
        if ch in NOT_ALIKE or proto == ch or len(proto) != 1:
            continue
        kind, to = unicodedata.category(ch), unicodedata.category(proto)
        if kind == "Lo":
            if to in ("Lu", "Ll", "Lo") and proto != BAR and not _part_of_syllable(proto):
                alike[ord(ch)] = proto
            continue
        if proto == BAR and kind == "Lu":
            proto = "I"
        if unicodedata.category(proto) == kind and unicodedata.name(proto).split()[0] != unicodedata.name(ch).split()[0]:
            alike[ord(ch)] = proto
    for a, b in list(alike.items()):  # a representative is its own
        while ord(b) in alike:
            b = alike[ord(b)]
        alike[a] = b
    unseen = jvm.com.ibm.icu.text.UnicodeSet("[[:DI:][:Cf:]-[:White_Space:]-[:Prepended_Concatenation_Mark:]]")
    invisible = {cp for i in range(unseen.getRangeCount()) for cp in range(unseen.getRangeStart(i), min(unseen.getRangeEnd(i), 0xE0FFF) + 1)}
    return alike, invisible


class _Fold(dict):
    """Code point -> what it shows: widths, joined letters, blanks, hyphens, invisible characters."""

    def __init__(self, invisible: set[int]) -> None:
        super().__init__(dict.fromkeys(invisible, ""))

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        kind, decomposed = unicodedata.category(ch), unicodedata.decomposition(ch).partition(" ")
        if kind == "Zs" or cp in (0x09, 0x85, 0x2028, 0x2029):
            to = " "
        elif cp in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212, 0xFE58, 0xFE63, 0xFF0D):
            to = "-"
        elif cp in (0x2019, 0x02BC):
            to = "'"
        elif decomposed[0] in WIDTH or (decomposed[0] == "<compat>" and (kind in ("Lu", "Ll", "Lt", "Lo", "Nl") or "RADICAL" in unicodedata.name(ch, ""))):
            to = "".join(self[int(x, 16)] for x in decomposed[2].split())
        else:
            to = ch
        self[cp] = to
        return to


class Looks:
    """Brings values to their key; picklable, one for each Python worker."""

    def __init__(self, alike: dict[int, str], invisible: set[int]) -> None:
        self.alike, self.invisible = alike, invisible
        self.fold = _Fold(invisible)

    def __getstate__(self):
        return self.alike, self.invisible

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def decomposed(self, text: str) -> str:
        """The characters that show, in one width each, with their accents apart."""
        return unicodedata.normalize("NFD", text.translate(self.fold))

    def form(self, text: str) -> str:
        if _ascii(text):
            return text.strip(" ")
        return unicodedata.normalize("NFC", self.decomposed(text).translate(self.alike)).strip(" ")


_cache: dict[str, Looks] = {}


def looks(spark: SparkSession) -> Looks:
    """The normaliser of this session (its tables are derived once)."""
    app = spark.sparkContext.applicationId
    if app not in _cache:
        _cache[app] = Looks(*lookalikes(spark))
    return _cache[app]


def text_udf(apply_of):
    """An Arrow UDF on text: `apply_of()` gives the function, once for each batch; equal values of a batch are mapped once."""
    import pyarrow as pa

    def run(values: pa.Array) -> pa.Array:
        apply = apply_of()
        own = values.dictionary_encode() if not pa.types.is_dictionary(values.type) else values
        to = pa.array([None if v is None else apply(v) for v in own.dictionary.to_pylist()], pa.string())
        return to.take(own.indices)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def look_form(spark: SparkSession, text: Column) -> Column:
    """The key of a column: equal for values that read the same; null stays null.

    Plain ASCII never leaves the JVM: the Python side gets nulls for it.
    """
    state = spark.sparkContext.broadcast(looks(spark))  # a few thousand letters at most, see lookalikes
    plain = text.rlike(r"\A[\x20-\x7e]*\z")
    return F.when(plain, F.trim(text)).otherwise(text_udf(lambda: state.value.form)(F.when(~plain, text)))


def link_part(raw: Column) -> Column:
    """A link as written, up to its first `\\|`, `|`, `#` or `^`, without blanks around it."""
    cut = F.regexp_extract(raw, r"^((?s:.*?))(?:\\\||\||#|\^|\z)", 1)
    return F.regexp_replace(cut, r"(?U)^\s+|\s+$", "")
