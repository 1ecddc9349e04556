"""Optional compact membership filters for (token, document) pairs.

A filter is a 3-wise binary fuse filter (Graf and Lemire, 2022): a key is stored if the fingerprints in its three slots
combine to its own, so there is never a false negative and a false positive has probability 2^-bits. Keys are cut into
shards of bounded size by their leading bits, and every shard has its own filter, so building scales with the cluster and
no task holds a whole tier. Construction works in whole-array rounds: all slots that belong to exactly one remaining key
are peeled at once, and fingerprints are assigned in the reverse order of rounds.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from glyphmill.operators.index import FILTER_SCHEMA, tier
from glyphmill.operators.search import DEFAULT_RESULTS, PROBE_SCHEMA, probes_of, ranked, scores
from glyphmill.operators.tables import cut_lineage

#: Fingerprint bits of each tier.
BITS = {"lo": 9, "hi": 16}
#: Keys that a shard is planned for.
SHARD_KEYS = 1_000_000
MAX_SEEDS = 100

_U = np.uint64
_HEADER = "<QIIIBxxx"
_HEADER_BYTES = struct.calcsize(_HEADER)


class FilterError(ValueError):
    """A filter that cannot be built or read."""


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@F.pandas_udf(LongType())
def _hashed(marked: pd.Series) -> pd.Series:
    import xxhash

    codes, distinct = pd.factorize(marked)
    return pd.Series(np.array([xxhash.xxh64_intdigest(t.encode()) for t in distinct], np.uint64).view(np.int64)[codes])


def token_key(marked: Column | str) -> Column:
    """xxHash64 with seed 0 of a token's UTF-8 bytes, as a signed number: Spark's own expression, which SQL offers with seed 42 only.

    A session without access to the JVM hashes the distinct tokens of each batch in Python instead.
    """
    marked = F.col(marked) if isinstance(marked, str) else marked
    context = SparkContext._active_spark_context
    if context is None:
        return _hashed(marked)
    jvm = context._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    children = jvm.org.apache.spark.api.python.PythonUtils.toSeq([utils.expression(marked._jc)])
    return Column(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(children, 0)))


@F.pandas_udf(LongType())
def pair_key(key: pd.Series, doc_id: pd.Series) -> pd.Series:
    """Key of a token in a document: the token's key combined with the mixed document id."""
    ids = mix(doc_id.to_numpy(np.int64).view(np.uint64) + _U(0x9E3779B97F4A7C15))
    return pd.Series((key.to_numpy(np.int64).view(np.uint64) ^ ids).view(np.int64))


def marked(kind: Column, token: Column) -> Column:
    """The token with the byte that tells its kind apart: none, 1 for initials, 2 for prefixes, 3 for title copies."""
    byte = {"cho": "\x01", "prefix": "\x02", "title": "\x03", "title_cho": "\x03\x01"}
    out = F.lit("")
    for k, b in byte.items():
        out = F.when(kind == k, F.lit(b)).otherwise(out)
    return F.concat(out, token)


def pair_keys(postings: DataFrame) -> DataFrame:
    """doc_id, kind, token, tier and key of every posting."""
    keyed = postings.withColumn("token_key", token_key(marked(F.col("kind"), F.col("token"))))
    return keyed.select("doc_id", "kind", "token", tier(F.col("kind")).alias("tier"), pair_key("token_key", "doc_id").alias("key"))


def segment_length(n: int) -> int:
    return 4 if n == 0 else min(1 << 18, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))


def layout(n: int) -> tuple[int, int]:
    """Segment length and number of slots for n keys."""
    segment = segment_length(n)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) if n > 1 else 0
    segments = max(1, -(-round(n * factor) // segment) - 2)
    return segment, (segments + 2) * segment


def blob_size(n: int, bits: int) -> int:
    return _HEADER_BYTES + (layout(n)[1] * bits + 7) // 8


def _high(a: np.ndarray, b: int) -> np.ndarray:
    """Upper 64 bits of the product with a number below 2^32."""
    low = (a & _U(0xFFFFFFFF)) * _U(b)
    return ((a >> _U(32)) * _U(b) + (low >> _U(32))) >> _U(32)


def _slots(hashes: np.ndarray, segment: int, slots: int) -> np.ndarray:
    """The three slots of each hash, in consecutive segments."""
    first = _high(hashes, slots - 2 * segment)
    mask = _U(segment - 1)
    second = (first + _U(segment)) ^ ((hashes >> _U(18)) & mask)
    third = (first + _U(2 * segment)) ^ (hashes & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes ^ (hashes >> _U(32))) & _U((1 << bits) - 1)).astype(np.uint16)


def _pack(values: np.ndarray, bits: int) -> bytes:
    places = (values[:, None] >> np.arange(bits, dtype=np.uint16)) & 1
    return np.packbits(places.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack(data: bytes, bits: int, slots: int) -> np.ndarray:
    places = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: slots * bits].reshape(slots, bits)
    return (places.astype(np.uint16) << np.arange(bits, dtype=np.uint16)).sum(axis=1, dtype=np.uint16)


def build(keys: np.ndarray, bits: int) -> bytes:
    """Filter of the keys; repeats count once. FilterError if no seed serves."""
    if not 8 <= bits <= 16:
        raise FilterError(f"fingerprints have from 8 to 16 bits, not {bits}")
    keys = np.unique(keys.view(np.uint64))
    n = len(keys)
    segment, slots = layout(n)
    for seed in mix(np.arange(1, MAX_SEEDS + 1, dtype=np.uint64)):
        hashes = mix(keys + seed)
        if len(np.unique(hashes)) < n:
            continue
        where = _slots(hashes, segment, slots)
        count = np.bincount(where.ravel(), minlength=slots)
        held = np.zeros(slots, np.int64)  # sum of the numbers of the keys in a slot
        for row in where:
            np.add.at(held, row, np.arange(n))
        rounds, left = [], n
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                break
            chosen, at = np.unique(held[alone], return_index=True)
            own = alone[at]
            rounds.append((chosen, own))
            for row in where[:, chosen]:
                np.subtract.at(count, row, 1)
                np.subtract.at(held, row, chosen)
            left -= len(chosen)
        if left:
            continue
        prints = np.zeros(slots, np.uint16)
        wanted = _prints(hashes, bits)
        for chosen, own in reversed(rounds):
            prints[own] = 0
            a, b, c = where[:, chosen]
            prints[own] = wanted[chosen] ^ prints[a] ^ prints[b] ^ prints[c]
        return struct.pack(_HEADER, int(seed), n, segment, slots, bits) + _pack(prints, bits)
    raise FilterError(f"no seed of {MAX_SEEDS} serves {n} keys")


class Filter:
    """A stored filter, opened for lookups."""

    def __init__(self, blob: bytes) -> None:
        if len(blob) < _HEADER_BYTES:
            raise FilterError("a filter is longer than that")
        self.seed, self.n, self.segment, self.slots, self.bits = struct.unpack_from(_HEADER, blob)
        if not 8 <= self.bits <= 16 or len(blob) < _HEADER_BYTES + (self.slots * self.bits + 7) // 8:
            raise FilterError("not a filter, or cut off")
        self.prints = _unpack(blob[_HEADER_BYTES :], self.bits, self.slots)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(keys), bool)
        hashes = mix(keys.view(np.uint64) + _U(self.seed))
        a, b, c = _slots(hashes, self.segment, self.slots)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == _prints(hashes, self.bits)


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


def build_filters(keys: DataFrame) -> DataFrame:
    """tier, shard, shards, n and blob: the filters of (tier, key) rows, each of about SHARD_KEYS keys at most, written once.

    The keys are counted first, so rows that are dear to compute should be written before (cut_lineage).
    """
    shards = max(1, -(-keys.count() // SHARD_KEYS))

    def make(key: tuple, rows: pa.Table) -> pa.Table:
        name, shard = (k.as_py() for k in key)
        blob = build(rows.column("key").to_numpy(), BITS[name])
        return pa.table({"tier": [name], "shard": pa.array([shard], pa.int32()), "shards": pa.array([shards], pa.int32()), "n": pa.array([Filter(blob).n], pa.int64()), "blob": pa.array([blob], pa.binary())})

    return cut_lineage(_sharded(keys.select("tier", "key"), shards).groupBy("tier", "shard").applyInArrow(make, FILTER_SCHEMA))


def probe(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of keys (tier, key and others) with `held`: whether the filters hold them. Keys go to their shard; filters aren't gathered.

    The filters must be stored ones, by build_filters or with an index, as the number of shards is read first.
    """
    shards = (filters.select("shards").first() or [1])[0]
    columns = keys.columns

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = left.column("key").to_numpy()
        held = Filter(right.column("blob")[0].as_py()).contains(numbers) if right.num_rows else np.zeros(len(numbers), bool)
        return left.select(columns).append_column("held", pa.array(held))

    asked = _sharded(keys, shards).groupBy("tier", "shard")
    schema = StructType([*keys.schema.fields, StructField("held", BooleanType())])
    return asked.cogroup(filters.select("tier", "shard", "blob").groupBy("tier", "shard")).applyInArrow(look, schema)


def filter_search(documents: DataFrame, filters: DataFrame, query: str | None, max_results: int = 0) -> DataFrame:
    """rank, doc_id, hits, title_hits by asking the filters about every document: the exact search's result and rare false matches.

    Work is documents times probes (33 at most) whatever matches, so the search over postings is the one for large corpora.
    """
    spark, limit = documents.sparkSession, max_results or DEFAULT_RESULTS
    rows = [(p[0], p[1], p[2], p[3]) for p in probes_of(query)]
    keyed = spark.createDataFrame(rows, PROBE_SCHEMA).select("pos", "is_title", tier(F.col("kind")).alias("tier"), token_key(marked(F.col("kind"), F.col("token"))).alias("token_key"))
    asked = [tuple(r) for r in keyed.collect()]  # the probes of one query
    structs = F.array(*(F.struct(F.lit(pos).alias("pos"), F.lit(title).alias("is_title"), F.lit(name).alias("tier"), F.lit(k).cast("bigint").alias("token_key")) for pos, title, name, k in asked))
    if not asked:
        return spark.createDataFrame([], "rank bigint, doc_id bigint, hits bigint, title_hits bigint")
    each = documents.select("doc_id", F.inline(structs)).select("doc_id", "pos", "is_title", "tier", pair_key("token_key", "doc_id").alias("key"))
    return ranked(scores(probe(each, filters).where("held"), ["doc_id"]), limit)


def filter_statistics(postings: DataFrame) -> DataFrame:
    """tier, keys and bytes that one filter of each tier would take."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([blob_size(c, BITS[t]) for t, c in zip(names, counts, strict=True)], pa.int64())], ["tier", "keys", "bytes"])

    counted = postings.groupBy(tier(F.col("kind")).alias("tier")).agg(F.count("*").alias("keys"))
    return counted.mapInArrow(sizes, "tier string, keys bigint, bytes bigint")
