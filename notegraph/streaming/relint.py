"""Findings of notes as they arrive: the schema rules need no other note, so they run on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.plans.build import parse
from notegraph.plans.lint import schema_findings


def stream_findings(notes: DataFrame, watermark: str | None = None, at: str = "captured_at") -> DataFrame:
    """path, code, detail of each note (path, text) of a batch or a stream; stateless.

    With a watermark, repeats of a note within it are dropped by path and time.
    """
    if watermark:
        notes = notes.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["path", at])
    parsed = parse(notes)
    tags = F.transform(T.body_tags(F.col("body")), lambda x: F.struct(F.lit("body tag").alias("code"), x.alias("detail")))
    return parsed.select("path", F.explode(F.concat(schema_findings(parsed), tags)).alias("f")).select("path", "f.code", "f.detail")
