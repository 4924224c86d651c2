"""A directory tree of notes as a DataFrame: a Python data source that also sees `_` files.

    register(spark)
    spark.read.format("vault").load("/path/to/vault")

Options: hidden = skip (default; any part of the path that starts with a dot), git (only .git) or
all; content = true (default) or false, which lists paths and sizes without reading a file.
Columns: path (NFC, relative, with slashes), bytes, content (binary, null for other files than
notes). The driver lists only the upper folders, until there are enough of them; tasks walk and
read what lies below.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES_IN_TASK = 500
#: Folders that the driver hands out at least, if there are so many within DEPTH levels.
FOLDERS, DEPTH = 64, 4


class _Part(InputPartition):
    """Some files, and a folder with all below it."""

    def __init__(self, files: list[str], folder: str | None = None) -> None:
        self.files, self.folder = files, folder


def _split(folder: str, hidden: str) -> tuple[list[str], list[str]]:
    """(folders, files) right below a folder."""
    skip = {"skip": lambda n: n.startswith("."), "git": lambda n: n == ".git", "all": lambda n: False}[hidden]
    folders, files = [], []
    for entry in os.scandir(folder):
        if entry.is_dir(follow_symlinks=False):
            if not skip(entry.name):
                folders.append(entry.path)
        elif entry.is_file() and (hidden != "skip" or not entry.name.startswith(".")):
            files.append(entry.path)
    return sorted(folders), sorted(files)


def _below(folder: str, hidden: str) -> Iterator[str]:
    todo = [folder]
    while todo:
        folders, files = _split(todo.pop(), hidden)
        todo += folders
        yield from files


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.hidden = options["path"], options.get("hidden", "skip")
        self.content = str(options.get("content", "true")).lower() == "true"

    def partitions(self):
        folders, files = [self.root], []
        for _ in range(DEPTH):
            if len(folders) >= FOLDERS:
                break
            split = [_split(f, self.hidden) for f in folders]
            folders = [d for below, _ in split for d in below]
            files += [f for _, own in split for f in own]
        parts = [_Part(files[i : i + FILES_IN_TASK]) for i in range(0, len(files), FILES_IN_TASK)]
        return [*parts, *(_Part([], f) for f in folders)] or [_Part([])]

    def read(self, partition):
        for real in chain(partition.files, _below(partition.folder, self.hidden) if partition.folder else ()):
            path, content = unicodedata.normalize("NFC", os.path.relpath(real, self.root).replace(os.sep, "/")), None
            if self.content and path.endswith(".md"):
                with open(real, "rb") as f:
                    content = f.read()
            yield path, os.path.getsize(real), content


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "path string, bytes bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VaultSource)


def decoded(content: Column, errors: str = "strict") -> Column:
    """Text of a file, line ends as \\n. strict raises on bytes that are no UTF-8, replace repairs
    them, skip gives null."""
    if errors == "strict":
        text = F.decode(content, "UTF-8")
    else:
        raw = content.cast("string")
        text = F.make_valid_utf8(raw) if errors == "replace" else F.when(F.is_valid_utf8(raw), raw)
    return F.regexp_replace(text, "\r\n?", "\n")


def read_vault(spark: SparkSession, root: str, hidden: str = "skip", errors: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(notes, targets): path, bytes, text of the notes; path of every file a link may mean."""
    register(spark)
    files = spark.read.format("vault").option("hidden", hidden).load(root)
    notes = files.filter(F.col("path").endswith(".md")).select("path", "bytes", decoded(F.col("content"), errors).alias("text"))
    targets = spark.read.format("vault").option("hidden", hidden).option("content", "false").load(root).select("path")
    return notes, targets


def folder_names(*folders: str) -> list[str]:
    """Names of the directories in some folders, without hidden ones; missing folders have none."""
    return sorted({unicodedata.normalize("NFC", d.name) for f in folders if os.path.isdir(f) for d in os.scandir(f) if d.is_dir() and not d.name.startswith(".")})
