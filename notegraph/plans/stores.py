"""What is written and read again: files of a vault, graph stores, triples as lines, a stream; and the older reading of single values."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions import legacy as L
from notegraph.functions import text as T
from notegraph.plans import older
from notegraph.plans.build import PARSED, SQL as BUILD_SQL, open_graph, parse, vault_graph, vault_notes
from notegraph.plans.catalog import _G, latest, stats
from notegraph.plans.lint import _sql as lint_sql
from notegraph.plans.rdf import _NOTE, CREATED, RDF_TYPE, VAULT, XSD_DATE, n_triples, read_n_triples, triples
from notegraph.plans.snapshot import placeholders
from notegraph.session import cut, release, work_folder
from notegraph.sources.tables import table
from notegraph.sources.vault import read_vault
from notegraph.streaming.relint import stream_findings

#: Names that links may mean besides notes, for the example of such links.
SKILLS = ["Atlas", "Todo"]


def _local(folder: str) -> str:
    """The path of a shared folder that is mounted; files of a vault can be nowhere else."""
    path = folder.removeprefix("file://").removeprefix("file:")
    if not path.startswith("/"):
        raise ValueError(f"a vault of files needs a mounted folder, not {folder}")
    return path


def write_files(notes: DataFrame, root: str) -> int:
    """Write notes (path, text) as files below a mounted folder, by the tasks; how many."""

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                real = os.path.join(root, path)
                os.makedirs(os.path.dirname(real), exist_ok=True)
                with open(real, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return notes.select("path", "text").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def vault_scan(spark: SparkSession, d: str) -> DataFrame:
    """path, bytes, length, zone of the texts, written as files of a vault and read back by its source."""
    folder = work_folder(spark, "vault")
    try:
        write_files(vault_notes(spark, d), _local(folder))
        notes, _ = read_vault(spark, _local(folder))
        return cut(notes.select("path", "bytes", F.length("text").alias("length"), T.path_zone(F.col("path")).alias("zone")))
    finally:
        release(spark, folder)


def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of the graph as its store gives them after it was written."""
    folder = work_folder(spark, "store")
    try:
        vault_graph(spark, d).write(folder)
        return cut(stats(open_graph(spark, folder)))
    finally:
        release(spark, folder)


def older_store(spark: SparkSession, d: str) -> DataFrame:
    """k, v: what the older store says of its making, and the numbers of its tables."""
    folder = work_folder(spark, "older")
    try:
        older.write_store(*older.build(vault_notes(spark, d)), folder)
        meta = spark.createDataFrame([(k, v) for k, v in older.open_meta(spark, folder).items() if k != "built"], "k string, v string")
        counts = [spark.read.parquet(f"{folder}/{t}").agg(F.lit(t).alias("k"), F.count(F.lit(1)).cast("string").alias("v")) for t in ("node", "edge", "tag")]
        out = meta
        for c in counts:
            out = out.unionByName(c)
        return cut(out)
    finally:
        release(spark, folder)


def rdf_lines(spark: SparkSession, d: str) -> DataFrame:
    """value: the lines of types, dates and summaries as they stand after they were written and read again."""
    folder = work_folder(spark, "triples")
    kinds = [RDF_TYPE, CREATED, f"{VAULT}summary"]
    try:
        n_triples(triples(latest(spark, d)).filter(F.col("p").isin(kinds))).write.text(folder)
        return cut(n_triples(read_n_triples(spark.read.text(folder))))
    finally:
        release(spark, folder)


def stream_lint(spark: SparkSession, d: str) -> DataFrame:
    """Findings on the documents' own fields, from a stream that reads all there is and ends."""
    docs = table(spark, d, "documents")
    path = F.concat(F.coalesce("path", F.concat(F.lit("inbox/doc"), F.col("doc_id").cast("string"), F.lit(".md"))), F.lit("#"), F.col("doc_id").cast("string"))
    arriving = spark.readStream.schema(docs.schema).parquet(f"{d}/documents.parque[t]")  # a pattern, as the table may be one file
    notes = arriving.filter("text IS NOT NULL").select(path.alias("path"), "text")
    folder = work_folder(spark, "stream")
    try:
        found = stream_findings(notes).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/found")
        found.awaitTermination()
        return cut(spark.read.schema("path string, code string, detail string").parquet(f"{folder}/found"))
    finally:
        release(spark, folder)


def older_fields(spark: SparkSession, d: str) -> DataFrame:
    """What the older functions read from each note: list, blocks, code, unmeant tags."""
    p = parse(vault_notes(spark, d))
    free = L.strip_code(F.col("body"))
    return p.select(
        "path", F.array_join(L.fm_list(F.col("fm"), "builds_on"), "|").alias("builds_on"), F.array_join(F.transform(L.fm_blocks(F.col("fm")), lambda b: b["key"]), "|").alias("blocks"),
        F.length(free).alias("code_free_length"), F.array_join(L.junk_tags(free), "|").alias("unmeant"),
    )


def link_kinds(spark: SparkSession, d: str) -> DataFrame:
    """raw, target, placeholder, skill, bad_name of each distinct link as written."""
    raws = table(spark, d, "edge").select("raw").filter("raw IS NOT NULL").distinct()
    target = L.link_target(F.col("raw"))
    return raws.select("raw", target.alias("target"), L.is_placeholder(target).alias("placeholder"), L.is_skill_ref(target, SKILLS).alias("skill"), L.bad_name(F.col("raw")).alias("bad_name"))


def placeholder_files(spark: SparkSession, d: str) -> DataFrame:
    """path, real: notes whose size is unknown, as a cloud drive would have left them, told from the listing."""
    node = table(spark, d, "node").filter("path IS NOT NULL")
    away = F.concat(F.regexp_extract("path", r"\A((?s:.*/)?)[^/]*\z", 1), F.lit("."), F.element_at(F.split("path", "/"), -1), F.lit(".icloud"))
    return placeholders(node.select(F.when(F.col("bytes").isNull(), away).otherwise(F.col("path")).alias("path")).distinct())


QUERIES = {f.__name__: f for f in (vault_scan, store_round_trip, older_store, rdf_lines, stream_lint, older_fields, link_kinds, placeholder_files)}

_ESCAPED = "replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"
_TYPE = f"'{VAULT}type/' || " + _NOTE.split("|| ", 1)[1]
_FILES_END = "GROUP BY 1),"
_STREAMED = "files AS (SELECT coalesce(path, 'inbox/doc' || doc_id || '.md') || '#' || doc_id AS path, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents WHERE text IS NOT NULL),"
_LINT = lint_sql("true", "true").replace("{to}", "true")
SQL = {
    "vault_scan": """WITH files AS (SELECT coalesce(path, 'inbox/doc' || doc_id || '.md') AS path, arg_max(text, (captured_at, doc_id)) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT nfc_normalize(path) AS path, octet_length(encode(text)) AS bytes, CAST(length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS INTEGER) AS length, string_split(nfc_normalize(path), '/')[1] AS zone
FROM files WHERE path LIKE '%.md' AND NOT regexp_matches(path, '(^|/)\\.')""",
    "store_round_trip": BUILD_SQL["build_stats"],
    "older_store": f"""WITH {older._OLD_EDGES}
SELECT 'excluded' AS k, '{" ".join(older.EXCLUDED)}' AS v UNION ALL SELECT 'node', count(*)::VARCHAR FROM live UNION ALL SELECT 'edge', count(*)::VARCHAR FROM joined
UNION ALL SELECT 'tag', coalesce(sum(len(regexp_extract_all(code_free, '(?:^|[^\\p{{L}}\\p{{N}}_`\\\\])#([A-Za-z가-힣][0-9a-zA-Z가-힣_-]*(?:/[0-9a-zA-Z가-힣_-]+)+)', 1))), 0)::BIGINT::VARCHAR FROM live""",
    "rdf_lines": f"""WITH {_G}
SELECT DISTINCT '<' || {_NOTE.format('path')} || '> <{RDF_TYPE}> <' || {_TYPE.format('type')} || '> .' AS value FROM gn WHERE type <> ''
UNION ALL SELECT DISTINCT '<' || {_NOTE.format('path')} || '> <{CREATED}> "' || {_ESCAPED.format('created')} || '"^^<{XSD_DATE}> .' FROM gn WHERE created <> ''
UNION ALL SELECT DISTINCT '<' || {_NOTE.format('path')} || '> <{VAULT}summary> "' || {_ESCAPED.format('summary')} || '"@ko .' FROM gn WHERE summary <> ''""",
    "stream_lint": "SELECT path, code, detail FROM (" + _LINT.replace(PARSED, _STREAMED + PARSED.split(_FILES_END, 1)[1]) + ") WHERE code NOT LIKE '% unresolved'",
    "older_fields": f"""WITH {older._OLD}, lines_of AS (SELECT path, list_filter(list_transform(string_split(coalesce(fm, ''), chr(10)), lambda x: regexp_extract(x, '^([\\p{{L}}\\p{{N}}_-]+):', 1)), lambda x: x <> '') AS keys FROM old)
SELECT o.path, array_to_string(ups, '|') AS builds_on, array_to_string(keys, '|') AS blocks, CAST(length(code_free) AS INTEGER) AS code_free_length, array_to_string({older._JUNK}, '|') AS unmeant FROM old o JOIN lines_of l ON l.path = o.path""",
    "link_kinds": f"""WITH r AS (SELECT DISTINCT raw, {older._CUT.format('raw')} AS target FROM edge WHERE raw IS NOT NULL)
SELECT raw, target, regexp_matches(target, '{L.PLACEHOLDER}') AS placeholder,
  target IN ({older._IN(SKILLS)}) OR (string_split(target, '/')[1] IN ({older._IN(SKILLS)}) AND starts_with(upper(string_split(target, '/')[-1]), 'SKILL')) AS skill, regexp_matches(raw, '[`\\[\\]|#^\\\\/:*?"<>]') AS bad_name FROM r""",
    "placeholder_files": f"""SELECT DISTINCT regexp_extract(path, '^((?s:.*/)?)[^/]*$', 1) || '.' || string_split(path, '/')[-1] || '.icloud' AS path, path AS real FROM node WHERE path IS NOT NULL AND bytes IS NULL""",
}
