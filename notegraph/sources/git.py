"""The states of a vault that a git repository holds: its last commit, its index and its files.

git is read on the driver, a file at a time, and only what differs; the states are two DataFrames
for plans.snapshot.
"""

from __future__ import annotations

import os
import shlex
import subprocess
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.plans.snapshot import line_count

#: Set in the environment, it lets a commit pass that deletes or shrinks notes.
OVERRIDE = "NOTEGRAPH_ALLOW_LOSS"
MARK = "notegraph pre-commit"


def _git(root: str, *args: str) -> bytes | None:
    done = subprocess.run(["git", "-C", root, "-c", "core.quotepath=off", *args], capture_output=True, check=False)
    return done.stdout if done.returncode == 0 else None


def _paths(root: str, *args: str) -> list[str]:
    return [p for p in (_git(root, *args, "-z") or b"").decode("utf-8", "replace").split("\0") if p.endswith(".md")]


def _text(root: str, place: str, path: str) -> str | None:
    """The text of a note at a revision (`HEAD:`), in the index (`:`) or in the folder (``)."""
    if place:
        got = _git(root, "show", place + path)
        return None if got is None else got.decode("utf-8", "replace")
    try:
        with open(os.path.join(root, path), encoding="utf-8", errors="replace", newline="") as f:
            return f.read()
    except FileNotFoundError:
        return None


def is_repository(root: str) -> bool:
    return _git(root, "rev-parse", "--git-dir") is not None


def states(spark: SparkSession, root: str, staged: bool = False) -> tuple[DataFrame, DataFrame]:
    """(head, now): path, lines of the notes that differ between the last commit and the folder, or the index if `staged`."""
    changed = _paths(root, "diff", "--cached", "--name-only", "--no-renames") if staged else sorted({*_paths(root, "diff", "--name-only", "--no-renames", "HEAD"), *_paths(root, "ls-files", "--deleted")})

    def of(place: str) -> DataFrame:
        rows: Iterator[tuple[str, str]] = ((p, t) for p in changed if (t := _text(root, place, p)) is not None)
        return spark.createDataFrame(list(rows), "path string, text string").select("path", line_count(F.col("text")).alias("lines"))

    return of("HEAD:"), of(":" if staged else "")


def restore(root: str, paths: list[str]) -> list[str]:
    """Take notes back from the index; those that are still missing."""
    for p in paths:
        _git(root, "checkout", "--", p)
    return [p for p in paths if not os.path.exists(os.path.join(root, p))]


def install_hook(root: str) -> tuple[str, str | None] | None:
    """(hook, where the one before it went); None: no repository. The hook runs the gate before each commit."""
    folder = os.path.join(root, ".git", "hooks")
    if not os.path.isdir(os.path.join(root, ".git")):
        return None
    os.makedirs(folder, exist_ok=True)
    hook, kept = os.path.join(folder, "pre-commit"), None
    if os.path.exists(hook):
        with open(hook, encoding="utf-8", errors="replace") as f:
            before = f.read()
        if MARK not in before:
            kept = f"{hook}.bak"
            with open(kept, "w", encoding="utf-8") as f:
                f.write(before)
    with open(hook, "w", encoding="utf-8") as f:
        f.write(f"#!/bin/sh\n# {MARK}\nexec {shlex.quote(sys.executable)} -m notegraph.cli pre-commit --vault {shlex.quote(os.path.abspath(root))}\n")
    os.chmod(hook, 0o755)
    return hook, kept
