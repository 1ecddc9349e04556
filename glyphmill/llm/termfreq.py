"""Occurrences and record frequency of every distinct term, from compressed record bitmaps.

The layout is vertical. Each Arrow batch is turned into one row per (term, block of 65,536 record ids): a container of the
ids in that block and an occurrence counter beside it. A container is a sorted list of 16-bit offsets while it has fewer
than 4,096 of them and an 8 KB bitmap from there on, so it never exceeds 8 KB however common the term is. Containers of the
same term and block meet in one shuffle and are merged by union; the record frequency is the sum of their cardinalities.
A term held by a third of all rows is spread over its blocks, and no task ever holds more than one group's union.

Defined results: null and empty texts hold no term but their rows count in the total; rows with a null id are counted in
the total and in no term; rows repeated with the same id are one record whose occurrences add up; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import tokenize

BLOCK_BITS = 16
BITMAP_BYTES = (1 << BLOCK_BITS) // 8
#: From so many entries on a container is a bitmap; a shorter one is a list, and never as long in bytes as a bitmap.
BITMAP_FROM = BITMAP_BYTES // 2

CONTAINERS = "term string, block bigint, ids binary, occurrences bigint"
MERGED = "term string, block bigint, records bigint, occurrences bigint"


def all_tokens(texts: list[str]) -> Column:
    """Tokens of all the texts, each split by itself; a null text gives none."""
    return F.concat(*(F.coalesce(tokenize(F.col(c)), F.array().cast("array<string>")) for c in texts))


def _bitmap(offsets: np.ndarray) -> bytes:
    bits = np.zeros(1 << BLOCK_BITS, np.uint8)
    bits[offsets] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _offsets(container: bytes) -> np.ndarray:
    if len(container) == BITMAP_BYTES:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little")).astype(np.uint16)
    return np.frombuffer(container, "<u2")


def container(offsets: np.ndarray) -> bytes:
    """The sorted distinct 16-bit offsets in the shorter of the two forms."""
    return _bitmap(offsets) if len(offsets) >= BITMAP_FROM else offsets.astype("<u2").tobytes()


def union(containers: list[bytes]) -> np.ndarray:
    """Sorted distinct offsets of several containers."""
    if any(len(c) == BITMAP_BYTES for c in containers):
        bits = np.zeros(BITMAP_BYTES, np.uint8)
        for c in containers:
            bits |= np.frombuffer(c if len(c) == BITMAP_BYTES else _bitmap(_offsets(c)), np.uint8)
        return _offsets(bits.tobytes())
    return np.unique(np.concatenate([_offsets(c) for c in containers]))


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of 16-bit values as one binary array, without copying them one by one."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * 2
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values.astype("<u2")))])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column(1)
        flat = tokens.flatten()
        if not len(flat):
            continue
        encoded = flat.dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        order = np.lexsort((ids, codes))
        codes, ids = codes[order], ids[order]
        new_pair = np.r_[True, (codes[1:] != codes[:-1]) | (ids[1:] != ids[:-1])]
        blocks = ids >> BLOCK_BITS
        new_group = np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])]
        at = np.flatnonzero(new_group)
        occurrences = np.diff(np.r_[at, len(codes)])
        sizes = np.add.reduceat(new_pair.astype(np.int64), at)
        low = (ids[new_pair] & ((1 << BLOCK_BITS) - 1)).astype("<u2")
        terms, group_blocks = encoded.dictionary.take(pa.array(codes[at])), blocks[at]
        big = sizes >= BITMAP_FROM
        starts = np.cumsum(sizes) - sizes
        small = np.flatnonzero(~big)
        keep = np.repeat(~big, sizes)
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(small)), pa.array(group_blocks[small]), _binary(low[keep], sizes[small]), pa.array(occurrences[small])], ["term", "block", "ids", "occurrences"])
        if big.any():
            which = np.flatnonzero(big)
            held = pa.array([container(low[starts[g] : starts[g] + sizes[g]]) for g in which], pa.binary())
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(which)), pa.array(group_blocks[which]), held, pa.array(occurrences[which])], ["term", "block", "ids", "occurrences"])


def _merged(rows: pa.Table) -> pa.RecordBatch:
    """One row per group of a table sorted by term and block."""
    rows = rows.combine_chunks()
    terms, blocks = rows.column("term").chunk(0), rows.column("block").to_numpy()
    change = np.r_[True, pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False) | (blocks[1:] != blocks[:-1])]
    at, group = np.flatnonzero(change), np.cumsum(change) - 1
    ids = rows.column("ids").chunk(0)
    lengths = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    is_bitmap = lengths == BITMAP_BYTES
    mixed = np.zeros(len(at), bool)
    mixed[group[is_bitmap]] = True
    plain = ~mixed[group]
    values = np.frombuffer(b"".join(ids.filter(pa.array(plain)).to_pylist()), "<u2").astype(np.int64)
    keys = np.unique(np.repeat(group[plain], lengths[plain] // 2) << BLOCK_BITS | values)
    records = np.bincount(keys >> BLOCK_BITS, minlength=len(at))
    for g in np.flatnonzero(mixed):
        end = at[g + 1] if g + 1 < len(at) else len(group)
        records[g] = len(union(ids[at[g] : end].to_pylist()))
    occurrences = np.add.reduceat(rows.column("occurrences").to_numpy(), at)
    return pa.RecordBatch.from_arrays([terms.take(pa.array(at)), pa.array(blocks[at]), pa.array(records.astype(np.int64)), pa.array(occurrences)], ["term", "block", "records", "occurrences"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None  # the rows of the last group, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        last = rows.slice(rows.num_rows - 1)
        same = np.asarray(pc.and_(pc.equal(rows.column("term"), last.column("term")[0]), pc.equal(rows.column("block"), last.column("block")[0])))
        first = int(np.argmax(same))
        held = rows.slice(first)
        if held.num_rows > 64:
            merged = container(union(held.column("ids").to_pylist()))
            held = pa.table({"term": held.column("term").slice(0, 1), "block": held.column("block").slice(0, 1), "ids": pa.array([merged], pa.binary()), "occurrences": pa.array([pc.sum(held.column("occurrences")).as_py()], pa.int64())})
        if first:
            yield _merged(rows.slice(0, first))
    if held is not None:
        yield _merged(held)


def term_frequencies(df: DataFrame, id_col: str, texts: list[str]) -> DataFrame:
    """term, occurrences and records (rows that hold it) of every distinct term of the texts."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), all_tokens(texts).alias("tokens"))
    containers = rows.mapInArrow(_build, CONTAINERS)
    together = containers.repartition("term", "block").sortWithinPartitions("term", "block")
    return together.mapInArrow(_merge, MERGED).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def usefulness(df: DataFrame, id_col: str, texts: list[str], rare_below: int = 2, common_share: float = 0.05) -> DataFrame:
    """term_frequencies with a verdict: rare below `rare_below` records, common above that share of all rows, else useful."""
    total = df.count()
    verdict = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(total * common_share), "common").otherwise("useful")
    return term_frequencies(df, id_col, texts).withColumn("verdict", verdict)
