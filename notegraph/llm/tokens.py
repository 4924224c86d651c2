"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the tokenizers' files, and the file used; both are parameters of token_count.
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE of this family cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose counts a worker remembers.
REMEMBERED = 400_000
_odd_blank = re.compile(r" (?:\s|\Z)").search
_cut_blank = re.compile(r" (?=\S)").split
_cut_inside = re.compile(r"(\s+)").split


class _Words(dict):
    """Number of tokens of a word after a blank.

    A cut before a single blank that a non-blank follows is a cut of PATTERN, too, so the counts of
    such pieces add up to that of the text. Inside a word, white space before a non-blank is
    counted as it is there, which differs from the same white space at the end of a text.
    """

    def __init__(self, encode) -> None:
        self.encode = encode
        self.starts: dict[str, int] = {}

    def piece(self, word: str) -> int:
        n = self.starts.get(word)
        if n is None:
            if len(self.starts) > REMEMBERED:
                self.starts.clear()
            n = self.starts[word] = len(self.encode(word))
        return n

    def inside(self, word: str, first: str) -> int:
        parts = _cut_inside(word)
        n = self.piece(first + parts[0]) if parts[0] or first else 0
        for space, part in zip(parts[1::2], parts[2::2]):
            n += self.piece(space + "a") - self.piece("a") + self.piece(part) if part else self.piece(space)
        return n

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = self[word] = self.inside(word, " ")
        return n

    def count(self, text: str) -> int:
        words = _cut_blank(text) if _odd_blank(text) else text.split(" ")
        return self.inside(words[0], "") + sum(map(self.__getitem__, words[1:]))


@lru_cache(4)
def words(folder: str, name: str) -> _Words:
    import tiktoken

    with open(f"{folder}/{name}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return _Words(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)


def token_count(text: Column, folder: str = FOLDER, name: str = NAME) -> Column:
    """Tokens of each text, whole; 0 for an empty or null text."""
    import pyarrow as pa

    def run(texts: pa.Array) -> pa.Array:
        count = words(folder, name).count
        return pa.array([count(t.as_py() or "") for t in texts], pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "bigint")(text)
