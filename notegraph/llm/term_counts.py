"""Frequency of every distinct term by recursive radix spilling, aggregated out of core with DuckDB."""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.operators.skew import heavy_keys
from notegraph.session import cut, release, work_folder

#: Rows, and bytes, of a partition that one DuckDB aggregates; larger ones are split further.
LEAF_ROWS = 500_000
LEAF_BYTES = 64 << 20
#: Hash bits of each level below the first, and the bits there are.
BITS, ALL_BITS = 4, 32
#: Rows of a task, and terms at most whose rows are spread over all tasks.
TASK_ROWS = 2_000_000
HOT_TERMS = 16_384
MEMORY = "256MB"
_ROWS = pa.schema([("term", pa.string()), ("record", pa.string()), ("raw", pa.string()), ("at", pa.string()), ("term_bits", pa.int32()), ("record_bits", pa.int32()), ("row_bits", pa.int32())])
_COUNTS = pa.schema([("term", pa.string()), ("n_rows", pa.int64()), ("n_records", pa.int64())])
#: Which bits split at the levels: the term's and the record's in turn, then those of the whole row.
_KINDS = [kind for i in range(ALL_BITS // BITS) for kind in ("term_bits", "record_bits")] + ["row_bits"] * (ALL_BITS // BITS)


def _file_system(folder: str):
    """(file system, path) of a shared folder."""
    import pyarrow.fs as pafs

    folder = folder.removeprefix("file://").removeprefix("file:")
    return (pafs.LocalFileSystem(), folder) if folder.startswith("/") else pafs.FileSystem.from_uri(folder)


class _Spill:
    """One partition on its way: held in memory while it is a leaf, else one file for each value of its next bits."""

    def __init__(self, fs, folder: str, level: int, kinds: list[str], leaf_rows: int) -> None:
        self.fs, self.folder, self.level, self.kinds, self.leaf_rows = fs, folder, level, kinds, leaf_rows
        self.held: list[pa.RecordBatch] = []
        self.rows = self.bytes = 0
        self.files: dict[int, pa.ipc.RecordBatchFileWriter] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        if self.files:
            self._write(batch)
            return
        self._hold([batch])
        if self._full():  # full repeats count once
            once = pa.Table.from_batches(self.held).group_by(_ROWS.names).aggregate([]).select(_ROWS.names).cast(_ROWS)
            self.held, self.rows, self.bytes = [], 0, 0
            self._hold(once.combine_chunks().to_batches(max_chunksize=100_000))
            if self._full(2) and self.level < len(self.kinds):
                for b in self.held:
                    self._write(b)
                self.held = []

    def _hold(self, batches: list[pa.RecordBatch]) -> None:
        self.held += batches
        self.rows += sum(b.num_rows for b in batches)
        self.bytes += sum(b.nbytes for b in batches)

    def _full(self, times: int = 1) -> bool:
        return self.rows > 1 and (self.rows * times > self.leaf_rows or self.bytes * times > LEAF_BYTES)

    def _write(self, batch: pa.RecordBatch) -> None:
        used = BITS * sum(k == self.kinds[self.level] for k in self.kinds[: self.level])
        bits = batch.column(self.kinds[self.level]).to_numpy().view("uint32")
        radix = (bits << used & 0xFFFFFFFF) >> (ALL_BITS - BITS)
        for r in set(radix.tolist()):
            if r not in self.files:
                if not self.files:
                    self.fs.create_dir(self.folder, recursive=True)
                self.files[r] = pa.ipc.new_stream(self.fs.open_output_stream(f"{self.folder}/{r}.arrow"), _ROWS)
            self.files[r].write_batch(batch.filter(pa.array(radix == r)))

    def leaves(self) -> Iterator[tuple[list[pa.RecordBatch], bool]]:
        """(rows of a leaf, whether its rows may be of a (term, record) that other leaves have, too)."""
        if not self.files:
            if self.held:
                yield self.held, self.level > len(self.kinds) - ALL_BITS // BITS
            return
        for r, writer in sorted(self.files.items()):
            writer.close()
            part = _Spill(self.fs, f"{self.folder}/{r}", self.level + 1, self.kinds, self.leaf_rows)
            path = f"{self.folder}/{r}.arrow"
            with self.fs.open_input_stream(path) as source:
                for batch in pa.ipc.open_stream(source):
                    part.add(batch)
            self.fs.delete_file(path)
            yield from part.leaves()


def _aggregate(folder: str, leaf_rows: int, memory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        fs, path = _file_system(folder)
        own = f"{path}/{uuid.uuid4().hex}"  # an attempt's files are its own
        top = _Spill(fs, own, 0, _KINDS, leaf_rows)
        try:
            for batch in batches:
                top.add(pa.RecordBatch.from_arrays([batch.column(n) for n in _ROWS.names], schema=_ROWS))
            seen: set = set()
            for rows, shared in top.leaves():
                local = own if path.startswith("/") else None
                if local:
                    os.makedirs(local, exist_ok=True)
                con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": f"{local}/duckdb" if local else ""})
                con.register("leaf", pa.Table.from_batches(rows))
                # only full repeats of a row count once
                got = con.sql(
                    "SELECT term, count(*)::BIGINT AS n_rows, count(DISTINCT record)::BIGINT AS n_records "
                    "FROM (SELECT DISTINCT term, record, raw, \"at\" FROM leaf) GROUP BY term"
                ).to_arrow_table().cast(_COUNTS)
                con.close()
                if shared:  # rows of one term in one record, split by their own hash: the record counts once
                    pairs = pa.Table.from_batches(rows).group_by(["term", "record"]).aggregate([]).to_pylist()
                    met = [(x["term"], x["record"]) for x in pairs if x["record"] is not None]
                    again = Counter(t for t, r in met if (t, r) in seen)
                    seen.update(met)
                    less = pa.array([again[t] for t in got["term"].to_pylist()], pa.int64())
                    got = got.set_column(2, "n_records", pc.subtract(got["n_records"], less))
                yield from got.combine_chunks().to_batches()
        finally:
            if fs.get_file_info(own).type.name == "Directory":
                fs.delete_dir(own)

    return run


def _routed(base: DataFrame, tasks: int, total: int) -> DataFrame:
    """`base` with the bits of its hashes, a partition for each task."""
    most = min(HOT_TERMS, 2 * tasks)
    hot = heavy_keys(base, "term", 1 / most, 4 * most, rows=total)
    bits = lambda *c: F.shiftright(F.xxhash64(*c), 32).cast("int")
    hashed = base.select("*", bits("term").alias("term_bits"), bits(F.lit(1), "record").alias("record_bits"), bits(F.lit(2), "raw", "at").alias("row_bits"))
    salt = F.when(F.col("term").isin(hot), F.xxhash64(F.lit(3), "record")) if hot else F.lit(None).cast("bigint")
    return hashed.repartition(tasks, F.xxhash64(F.lit(4), "term"), salt)


def term_counts(rows: DataFrame, leaf_rows: int = LEAF_ROWS, memory: str = MEMORY, task_rows: int = TASK_ROWS) -> DataFrame:
    """term, n_rows, n_records for every distinct term.

    rows: record, term, raw, at - rows equal in all four count once; null terms are ignored, null
    records count as rows but as no record. Empty input gives no rows.

    The first radix level is the exchange: by the term's hash, and for the terms that hold more than
    half a task's share of all rows (a sketch finds HOT_TERMS of them at most) by the record's, too,
    so no task gets much more than another; counts of disjoint sets of records add up. A task keeps
    its partition in memory while that is a leaf. Otherwise it writes it to the shared folder, one
    file for each value of the next hash bits, of the term and of the record in turn, and splits
    files that are still too large again. Each leaf is aggregated by DuckDB with bounded memory; it
    may spill to the shared folder where that is mounted, else leaves are all it may hold. Rows of
    one term in one record, however many, are split by their own hash. Nothing of this passes the
    driver; a lost executor costs its tasks only, and their files are removed at the end.
    """
    spark = rows.sparkSession
    base = rows.filter(F.col("term").isNotNull()).select("term", F.col("record").cast("string").alias("record"), F.col("raw").cast("string").alias("raw"), F.col("at").cast("string").alias("at"))
    total = base.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_rows))
    folder = work_folder(spark, "radix")
    try:
        parts = _routed(base, tasks, total).mapInArrow(_aggregate(folder, leaf_rows, memory), "term string, n_rows bigint, n_records bigint")
        return cut(parts.groupBy("term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records")))
    finally:
        release(spark, folder)


def marks(counts: DataFrame, total: int, rare: int = 3, common: float = 0.04) -> DataFrame:
    """`counts` with mark: `rare` below `rare` records, `common` above the share `common` of `total`, else null."""
    n = F.col("n_records")
    return counts.withColumn("mark", F.when(n < rare, "rare").when(n > F.lit(common) * total, "common"))
