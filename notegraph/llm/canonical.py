"""Mapping freely typed values to a canonical list: a pigeonhole join in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.operators.skew import heavy_keys, skew_join
from notegraph.session import cut

_BLANK = r"(?U)^\\s*$"


def _form(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^\\\\p{{{{L}}}}\\\\p{{{{Nd}}}}]', '')"


def _swap(s: str, i: str) -> str:
    return f"concat(substr({s}, 1, {i} - 1), substr({s}, {i} + 1, 1), substr({s}, {i}, 1), substr({s}, {i} + 2))"


def _places(s: str) -> str:
    return f"sequence(1, greatest(length({s}) - 1, 1))"


#: Slips between v and f, up to 2: a character inserted, lost or replaced, or two neighbours
#: swapped. Swaps are undone on either side before the built-in levenshtein.
_SLIPS = f"""
CASE WHEN v = f THEN 0
     WHEN k >= 1 AND (levenshtein(v, f, 1) >= 0 OR exists({_places("v")}, i -> {_swap("v", "i")} = f)) THEN 1
     WHEN k >= 2 AND (levenshtein(v, f, 2) >= 0
          OR exists({_places("v")}, i -> levenshtein({_swap("v", "i")}, f, 1) >= 0)
          OR exists({_places("f")}, i -> levenshtein(v, {_swap("f", "i")}, 1) >= 0)
          OR exists(transform({_places("v")}, i -> {_swap("v", "i")}), w -> exists({_places("v")}, j -> {_swap("w", "j")} = f))) THEN 2
END"""

#: Names with their allowed slips k, cut into k + 1 segments. A swap over the border of two
#: segments would hurt both, so names are also cut with the letters at each border swapped.
_SEGMENTS = f"""
WITH names AS (
  SELECT DISTINCT entry, {_form("name")} AS f FROM (SELECT entry, explode(array_append(coalesce(also, array()), entry)) AS name FROM {{ref}})
  WHERE name IS NOT NULL),
sized AS (SELECT entry, f, length(f) AS len, CASE WHEN length(f) < 4 THEN 0 WHEN length(f) < 7 THEN 1 ELSE 2 END AS k FROM names WHERE f <> ''),
bordered AS (SELECT *, transform(slice(sequence(0, k), 2, k), i -> CAST(floor(len * i / (k + 1)) AS INT)) AS borders FROM sized),
spelled AS (
  SELECT entry, f, len, k, explode(array_distinct(flatten(array(
    array(f),
    transform(borders, b -> {_swap("f", "b")}),
    CASE WHEN k = 2 THEN array({_swap("(" + _swap("f", "borders[0]") + ")", "borders[1]")}) ELSE array() END)))) AS g FROM bordered)
SELECT DISTINCT entry, f, len, k, i, CAST(floor(len * i / (k + 1)) AS INT) + 1 AS pos,
       CAST(floor(len * (i + 1) / (k + 1)) - floor(len * i / (k + 1)) AS INT) AS width,
       substr(g, CAST(floor(len * i / (k + 1)) AS INT) + 1, CAST(floor(len * (i + 1) / (k + 1)) - floor(len * i / (k + 1)) AS INT)) AS segment
FROM spelled LATERAL VIEW explode(sequence(0, k)) AS i"""

_MATCHES = f"""
WITH shapes AS (SELECT DISTINCT len, k, i, pos, width, n FROM {{seg}} LATERAL VIEW explode(sequence(len - k, len + k)) AS n),
probes AS (
  SELECT DISTINCT v, len, i, substr(v, pos + shift, width) AS segment
  FROM (SELECT v, s.*, explode(sequence(-k, k)) AS shift FROM {{forms}} JOIN shapes s ON s.n = length(v))
  WHERE pos + shift >= 1),
met AS (SELECT DISTINCT p.v, s.entry, s.f, s.k FROM probes p JOIN {{seg}} s ON p.len = s.len AND p.i = s.i AND p.segment = s.segment),
scored AS (SELECT v, entry, {_SLIPS} AS slips FROM met)
SELECT v, min_by(entry, struct(slips, entry)) AS entry, min(slips) AS slips FROM scored WHERE slips IS NOT NULL GROUP BY v"""


def canonical_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """value, entry, slips for each distinct value of `values` that needs mapping; entry `?`: none.

    values: column value. reference: entry, also (further names). Null and blank values and those
    that are exactly an entry need no mapping. Names and values are compared by letters and digits
    only, without case; names under 4 of these allow no slip, 4 to 6 one, longer ones two. The
    fewest slips win, a tie goes to the smaller entry by code point. An empty reference leaves all
    values unmatched; entries that are null are skipped. A very long value has no candidate, as
    candidates differ by two letters in length at most.

    SQL only, each part written once: segments of the names are equi-joined with substrings of the values at the same
    place (give or take the slips), candidates are verified with the built-in levenshtein, and
    unmatched values come from an anti join.
    """
    spark = values.sparkSession
    ref = reference.select("entry", "also").filter("entry IS NOT NULL")
    typed = cut(spark.sql(
        f"SELECT DISTINCT value, {_form('value')} AS v FROM {{values}} t WHERE value IS NOT NULL AND NOT value RLIKE '{_BLANK}' "
        "AND NOT EXISTS (SELECT 1 FROM {ref} r WHERE r.entry = t.value)",
        values=values.select("value"), ref=ref,
    ))
    seg = cut(spark.sql(_SEGMENTS, ref=ref))
    matched = cut(spark.sql(_MATCHES, seg=seg, forms=typed.select("v").distinct()))
    return spark.sql(
        "SELECT t.value, m.entry, m.slips FROM {typed} t JOIN {matched} m ON t.v = m.v UNION ALL "
        "SELECT t.value, '?', CAST(NULL AS INT) FROM {typed} t LEFT ANTI JOIN {matched} m ON t.v = m.v",
        typed=typed, matched=matched,
    )


def canonical_rows(rows: DataFrame, row_id: str, value: str, reference: DataFrame) -> DataFrame:
    """row_id, entry for each row whose value needs mapping; repeated rows count once.

    Further columns of `rows` may have any name. A null row_id is kept as such.
    """
    ids = rows.select(rows[row_id].alias("_id"), rows[value].alias("value")).distinct()
    mapped = canonical_values(ids, reference).select("value", "entry")
    return skew_join(ids, mapped, "value", "inner", heavy_keys(ids, "value", rows=rows.count())).select(F.col("_id").alias(row_id), "entry")
