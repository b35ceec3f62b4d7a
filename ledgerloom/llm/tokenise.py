"""Encoding texts by a byte-level BPE vocabulary, with a segment tree per piece.

A piece of text (a run that the tokenizer's pattern allows to merge) starts as bytes. The leaves of a segment tree
hold the rank of each live byte position's pair with its right neighbour; each inner node holds the least rank below it
and, among equals, the leftmost position. The root is the next merge; a merge removes one position from the linked list of live neighbours
and updates two leaves, so a piece of n bytes takes O(n log n) however its merges fall.

The same piece recurs constantly, so each worker keeps a bounded table of encoded pieces. Only that it is encoded once
depends on the table, never the result.
"""

from __future__ import annotations

import base64
import importlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.workspace import ship_package

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces a worker remembers; some 100 bytes each.
REMEMBERED = 300_000


def vocabulary_path(name: str = DEFAULT_VOCABULARY, folder: str | None = None) -> str:
    """The place of a public vocabulary file: in `folder` if given, else in the installed package of tokenizers."""
    if folder:
        return str(Path(folder) / name)
    try:
        return importlib.import_module("public_tokenizers").path(name)
    except ImportError:
        return str(Path("/opt/tokenizers") / name)


# Fixed value: the published pattern of the vocabulary, which says where merges stop.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A text can be cut before the pattern is applied at a blank between two characters that are no white space: the
# pattern ends a match there and lets the next begin with the blank. So it is applied to words, most of which recur.
_SPACE = r"[\s\x1c-\x1f\x85]"
_WORDS = re.compile(rf"(?<!{_SPACE}) (?!{_SPACE})")
_BESIDE = re.compile(rf" {_SPACE}|{_SPACE} |\A |\Z(?<= )")
_ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_NONE = 1 << 40


def _plain(text: str) -> bool:
    """True if every blank of `text` is between two characters that are no white space."""
    if text.isascii() and not any(c in text for c in _ODD_ASCII):
        return not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ")
    return _BESIDE.search(text) is None


class Encoder:
    """Encodes texts by the ranks in a vocabulary file of lines `base64 rank`."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(PIECES)
        self.remembered = remembered
        self.pieces: dict[str, list[int]] = {}
        self.after_blank: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        ranks = self.ranks
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << (n - 1).bit_length()
        # A node is rank * size + position: its minimum is the least rank and, among equals, the leftmost position.
        none = _NONE * size
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        while (least := tree[1]) < none:
            i = least % size
            gone = nxt[i]
            after = nxt[gone]
            nxt[i] = after
            put(gone, none)
            if after < n:
                prv[after] = i
                r = ranks.get(piece[i : nxt[after]])
                put(i, none if r is None else r * size + i)
            else:
                put(i, none)
            before = prv[i]
            if before >= 0:
                r = ranks.get(piece[before:after])
                put(before, none if r is None else r * size + before)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : nxt[i]]])
            i = nxt[i]
        return out

    def _word(self, word: str) -> list[int]:
        """The ids of a stretch between two places where a text can be cut."""
        ids: list[int] = []
        pieces = self.pieces
        for piece in self.pattern.findall(word):
            got = pieces.get(piece)
            if got is None:
                got = self.merge(piece.encode("utf-8"))
                self._remember(pieces, piece, got)
            ids += got
        return ids

    def _remember(self, table: dict[str, list[int]], text: str, ids: list[int]) -> None:
        if len(text) <= 64:
            if len(table) >= self.remembered:
                table.clear()
            table[text] = ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text; none for an empty one."""
        after_blank, word = self.after_blank, self._word
        parts = text.split(" ") if not text or _plain(text) else _WORDS.split(text)
        out = list(word(parts[0]))
        for part in parts[1:]:
            got = after_blank.get(part)
            if got is None:
                got = word(" " + part)
                self._remember(after_blank, part, got)
            out += got
        return out


_shipped: set[tuple[str, str]] = set()


def ship_vocabulary(spark: SparkSession, path: str) -> None:
    """Hand the driver's vocabulary file to the executors, once per application, so that no machine needs a copy of its own."""
    at = (spark.sparkContext.applicationId, path)
    if at not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add(at)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker, from the file that `ship_vocabulary` sent."""
    return Encoder(SparkFiles.get(Path(path).name))


def _lists(texts: pa.ChunkedArray | pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's begin (and end)."""
    enc = encoder(path)
    flat: list[np.ndarray] = []
    ends = [0]
    for text in texts:
        value = text.as_py()
        ids = np.array(enc.encode(value), dtype=np.int32) if value else np.zeros(0, np.int32)
        flat.append(ids)
        ends.append(ends[-1] + len(ids))
    return np.concatenate(flat) if flat else np.zeros(0, np.int32), np.array(ends, dtype=np.int32)


def encode_corpus(documents: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The ids of every text: key, ids (a list of integers, without special tokens).

    Null and empty texts have an empty list. Repeated rows give a row each; extra columns are ignored. No shuffle: texts
    stream through the workers in Arrow batches.
    """
    path = vocabulary or vocabulary_path()
    ship_package(documents.sparkSession)
    ship_vocabulary(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # So that a batch of very long texts does not become one of very long lists.
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                flat, ends = _lists(part.column(1), path)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    rows = documents.select(key, F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, *keep: str | Column, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` and `n_tokens` of every text; 0 for null and empty ones."""
    path = vocabulary or vocabulary_path()
    ship_package(documents.sparkSession)
    ship_vocabulary(documents.sparkSession, path)
    rows = documents.select(F.col(text).cast("string").alias("__text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]) + ", n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = encoder(path)
            counts = pa.array([len(enc.encode(t)) if t else 0 for t in (x.as_py() for x in b.column(0))], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], counts], names=[*b.schema.names[1:], "n_tokens"])

    return rows.mapInArrow(run, schema)
