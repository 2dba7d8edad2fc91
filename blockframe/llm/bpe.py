"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 7).

Each pre-token is merged with a priority queue of merge ranks over a doubly linked list of symbols; queue entries whose
symbols have changed since are stale and skipped. Decoding concatenates the vocabulary's strings. The result for a
pre-token does not depend on its surroundings, so each worker keeps the results of the pre-tokens it has met, up to
``CACHE`` of them (a documented memory bound, beyond which results are computed again; no result depends on it).

Defined cases: an empty and a null text have no ids; text that spells a special token is ordinary text; unpaired surrogates
become the replacement character; repeated rows are encoded each; the table's other columns, whatever their names, are unused.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
CACHE = 400_000
#: Ids that one output batch holds before it is sent on.
BATCH_IDS = 1_000_000

_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_WHOLE = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if visible, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class Pieces(dict):
    """Ids of pre-tokens, computed when first asked for."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> array:
        ids = array("i", self.bpe.merge(piece))
        if len(self) < CACHE:
            self[piece] = ids
        return ids


class Bpe:
    """A byte-level BPE vocabulary: ``merges`` maps a pair of ids to (rank, id of the joined symbol)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocabulary[c] for c in letters]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in vocabulary.items() if all(c in byte_of for c in s)}
        self.pieces = Pieces(self)

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.first[b] for b in piece.encode("utf-8", "replace")]
        n = len(ids)
        if n == 1:
            return ids
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := self.merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, joined = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = joined, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if found := self.merges.get((joined, ids[k])):
                    heapq.heappush(queue, (found[0], i, joined, ids[k], found[1]))
            h = left[i]
            if h >= 0 and (found := self.merges.get((ids[h], joined))):
                heapq.heappush(queue, (found[0], h, ids[h], joined, found[1]))
        return [x for x in ids if x >= 0]

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; together they are the text."""
        return _ASCII.findall(text) if text.isascii() else _WHOLE.findall(text)

    def encode(self, text: str | None) -> array:
        """Ids of a text."""
        if not text:
            return array("i")
        return array("i", chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        return sum(map(len, map(self.pieces.__getitem__, self.split(text)))) if text else 0

    def decode(self, ids) -> str:
        """The text of ids."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> Bpe:
    """The vocabulary, read once in each Python process."""
    path = os.path.join(tokenizers, name)
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(df: DataFrame, id_column: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(id_column, ids): the ids of every text, in one pass without a shuffle."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizers, name)
        for batch in batches:
            begin, ids, offsets = 0, array("i"), array("i", [0])
            for at, value in enumerate(batch.column(1)):
                ids.extend(bpe.encode(value.as_py()))
                offsets.append(len(ids))
                if len(ids) >= BATCH_IDS or at == batch.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at + 1 - begin), lists], [id_column, "ids"])
                    begin, ids, offsets = at + 1, array("i"), array("i", [0])

    return df.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str = "text", tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``df`` with ``n_tokens``, the number of ids of ``text``, instead of ``text``."""
    rest = [c for c in df.columns if c != text]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizers, name)
        for batch in batches:
            counts = array("i", (bpe.count(v.as_py()) for v in batch.column(len(rest))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(counts, pa.int32())], [*rest, "n_tokens"])

    return df.select(*rest, text).mapInArrow(run, f"{fields}, n_tokens int")


def decode(df: DataFrame, ids: str = "ids", tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``df`` with ``text``, the decoded ids, instead of ``ids``."""
    rest = [c for c in df.columns if c != ids]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizers, name)
        for batch in batches:
            texts = [bpe.decode(v.as_py() or ()) for v in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], [*rest, "text"])

    return df.select(*rest, F.col(ids)).mapInArrow(run, f"{fields}, text string")
