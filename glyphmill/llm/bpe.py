"""Encoding of texts with a public byte-level BPE vocabulary, and decoding back.

A text is cut into pieces by the vocabulary's pattern. Inside a piece the symbols form a doubly linked list, and the pairs
that may merge lie in a priority queue by merge rank and place; an entry whose symbols have changed since is stale and
skipped. Before that a piece is cut wherever two neighbouring bytes stand beside each other in no vocabulary entry: no
merge can ever reach across, so the parts can be encoded, and remembered, by themselves. That keeps long runs of scripts
without spaces from costing more than their length.

Every row is encoded where it lies; nothing is shuffled. The vocabulary (about 1 MB, fixed) is sent to the workers once.

Defined results: a null or empty text has the empty list; everything in a text is ordinary text, also the strings of
special tokens; bytes that aren't UTF-8 are read as U+FFFD; repeated rows stay repeated; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the published cutting pattern of this family of vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Entries that a worker remembers; it forgets all of them beyond that, so its memory is bounded.
REMEMBERED = 150_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Vocabulary entries by their bytes, from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Encoder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks, self.tokens = ranks, {i: token for token, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        self.parts: dict[bytes, list[int]] = {}
        self.near = np.zeros((256, 256), bool)
        for token in ranks:
            if len(token) > 1:
                x = np.frombuffer(token, np.uint8)
                self.near[x[:-1], x[1:]] = True

    def merge(self, data: bytes) -> list[int]:
        """Ids of a run of bytes by repeated merging of the lowest-ranked pair, leftmost first."""
        ranks, n = self.ranks, len(data)
        symbols: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(ranks[data[i : i + 2]], i, data[i : i + 2]) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapify(queue)
        while queue:
            _, i, both = heappop(queue)
            left = symbols[i]
            j = after[i]
            if left is None or j >= n or left + symbols[j] != both:
                continue  # stale: one of the two has merged with another since
            symbols[i], symbols[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(new := both + symbols[k])) is not None:
                    heappush(queue, (rank, i, new))
            if (h := before[i]) >= 0 and (rank := ranks.get(new := symbols[h] + both)) is not None:
                heappush(queue, (rank, h, new))
        return [ranks[s] for s in symbols if s is not None]

    def _part(self, part: bytes) -> list[int]:
        if (ids := self.parts.get(part)) is None:
            whole = self.ranks.get(part)
            ids = [whole] if whole is not None and len(part) == 1 else self.merge(part)
            if len(part) <= 64:
                if len(self.parts) >= REMEMBERED:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode()
        if len(data) < 2:
            return self._part(data)
        x = np.frombuffer(data, np.uint8)
        ids: list[int] = []
        at = 0
        for cut in (np.flatnonzero(~self.near[x[:-1], x[1:]]) + 1).tolist():
            ids += self._part(data[at:cut])
            at = cut
        return ids + self._part(data[at:]) if at else self._part(data)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.known
        for piece in self.pieces(text):
            if (found := known.get(piece)) is None:
                found = self._piece(piece)
                if len(piece) <= 24:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


def _vocabulary(df: DataFrame, tokenizer_dir: str, vocabulary: str):
    with open(f"{tokenizer_dir}/{vocabulary}", "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str, text_col: str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """id_col and ids, the list of integers of each row's text."""
    shared = _vocabulary(df, tokenizer_dir, vocabulary)
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_ranks(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat: list[int] = []
                ends = [0]
                for text in part.column(1):
                    if data := text.as_py():
                        flat += encoder.encode(data.decode("utf-8", "replace"))
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str, ids_col: str = "ids", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """id_col and text, by joining the vocabulary strings of each row's ids; a null list gives a null text."""
    shared = _vocabulary(df, tokenizer_dir, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: token for token, i in load_ranks(shared.value).items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(tokens[i] for i in ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return df.select(id_col, ids_col).mapInArrow(run, schema)
