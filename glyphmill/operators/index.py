"""Building, storing and opening a search index: postings of five kinds and the stored document fields.

Postings are made inside the row: the fields are tokenized, stopwords dropped, words made distinct and expanded before
anything is exploded, so building shuffles nothing. Kinds: `exact` words, `prefix` beginnings of words of prefix fields,
`cho` initial consonants, `title` copies of title words and `title_cho` of their initials, for ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.config import IndexConfig
from glyphmill.functions.text import ascii_lower, edge_ngrams, initials_prefixes, tokenize
from glyphmill.sources.corpus import plain_number

VERSION = 2
KINDS = ("exact", "prefix", "cho", "title", "title_cho")
#: Kinds for which the compact filters spend more bits, as a false match there is costlier.
HIGH_TIER = ("prefix", "title", "title_cho")

#: Documents whose postings of one token are written by one task.
DOCUMENTS_PER_FILE = 1_000_000
#: Folders into which the postings of each kind go by a hash of the token, so a lookup opens the files of its folder only.
TOKEN_BUCKETS = 64

_NONE = "array<string>"


class IndexError_(ValueError):
    """A stored index that cannot be opened."""


def _no_words() -> Column:
    return F.array().cast(_NONE)


def token_bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def tier(kind: Column) -> Column:
    return F.when(kind.isin(*HIGH_TIER), "hi").otherwise("lo")


def field_words(corpus: DataFrame, field: str, stopwords: tuple[str, ...] | None) -> Column:
    """Distinct tokens of a field without stopwords; none if the field is missing or no string."""
    if field not in corpus.columns or dict(corpus.dtypes)[field] != "string":
        return _no_words()
    words = F.coalesce(tokenize(F.col(f"`{field}`")), _no_words())
    return F.array_except(words, F.array(*map(F.lit, stopwords))) if stopwords else F.array_distinct(words)


def _union(columns: list[Column]) -> Column:
    return F.array_distinct(F.concat(*columns)) if columns else _no_words()


def words(corpus: DataFrame, config: IndexConfig) -> DataFrame:
    """doc_id and the word lists of each document: all, title and prefix (distinct each)."""
    config.checked()
    lists = corpus.select("doc_id", *(field_words(corpus, f, config.stopwords).alias(f"f{i}") for i, f in enumerate(config.indexed_fields)))
    pick = lambda wanted: _union([F.col(f"f{i}") for i, f in enumerate(config.indexed_fields) if f in wanted])
    return lists.select("doc_id", pick(config.indexed_fields).alias("all"), pick(("title",)).alias("title"), pick(config.prefix_fields).alias("prefix"))


def _expanded(column: str, expand) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.col(column), expand)))


def postings_of_words(lists: DataFrame, initials_max_len: int) -> DataFrame:
    """doc_id, kind, token from the word lists of documents."""
    shown = lists.select(
        "doc_id",
        F.col("all").alias("exact"),
        "title",
        _expanded("prefix", edge_ngrams).alias("prefix"),
        (_expanded("all", lambda w: initials_prefixes(w, 2, initials_max_len)) if initials_max_len else _no_words()).alias("body_cho"),
        (_expanded("title", lambda w: initials_prefixes(w, 1, initials_max_len)) if initials_max_len else _no_words()).alias("title_cho"),
    ).withColumn("cho", F.array_union("body_cho", "title_cho"))
    of_kind = lambda kind: F.transform(F.col(kind), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))
    every = F.concat(*map(of_kind, KINDS))
    return shown.select("doc_id", F.inline(every))


def postings(corpus: DataFrame, config: IndexConfig) -> DataFrame:
    """doc_id, kind, token: every distinct posting of a corpus."""
    return postings_of_words(words(corpus, config), config.initials_max_len)


def pretokenized_postings(documents: DataFrame, tokens: str, initials_max_len: int = 3) -> DataFrame:
    """Postings of documents that come as token lists: distinct tokens as `exact`, and initials of two letters and more."""
    words_ = F.array_distinct(F.filter(F.coalesce(F.col(tokens), _no_words()), lambda t: t.isNotNull()))
    return postings_of_words(documents.select("doc_id", words_.alias("all"), _no_words().alias("title"), _no_words().alias("prefix")), initials_max_len)


def stored_documents(corpus: DataFrame, config: IndexConfig) -> DataFrame:
    """doc_id, title, url and meta of each document; a missing or null field is empty."""
    shown = lambda f: plain_number(F.col(f"`{f}`")) if dict(corpus.dtypes)[f] in ("double", "float") else F.col(f"`{f}`").cast("string")
    text = lambda f: F.coalesce(shown(f), F.lit("")) if f in corpus.columns else F.lit("")
    only = lambda f: text(f) if dict(corpus.dtypes).get(f) == "string" else F.lit("")
    pairs = [x for f in dict.fromkeys(config.metadata_fields) for x in (F.lit(f), text(f))]
    return corpus.select("doc_id", only("title").alias("title"), only(config.url_field).alias("url"), F.create_map(*pairs).cast("map<string,string>").alias("meta"))


def can_hold(corpus: DataFrame, config: IndexConfig, kinds: set[str], tokens: set[str]) -> Column:
    """A necessary condition, cheap to test: tokens are parts of the text, and initials come from Hangul syllables."""
    fields = [ascii_lower(F.col(f"`{f}`")) for f in config.indexed_fields if dict(corpus.dtypes).get(f) == "string"]
    out = F.lit(False)
    for text in fields:
        if kinds & {"cho", "title_cho"}:
            out |= F.coalesce(text.rlike(r"[\x{AC00}-\x{D7A3}]"), F.lit(False))
        for token in tokens:
            out |= F.coalesce(F.contains(text, F.lit(token)), F.lit(False))
    return out


ABOUT_SCHEMA = "version int, buckets int, metadata_fields array<string>, filters boolean"
STORED_SCHEMA = "doc_id bigint, token string, kind string, bucket int"
DOCUMENT_SCHEMA = "doc_id bigint, title string, url string, meta map<string,string>"
FILTER_SCHEMA = "tier string, shard int, shards int, n bigint, blob binary"


def write_postings(postings_: DataFrame, path: str) -> None:
    """Postings in folders by kind and bucket of the token, sorted by token in each file, with a bloom filter on it.

    They go to tasks by bucket and document range: a lookup finds its folder by hash, and a token held by most documents is
    spread over several tasks.
    """
    placed = postings_.withColumn("bucket", token_bucket(F.col("token"), TOKEN_BUCKETS))
    spread = placed.repartition("bucket", F.floor(F.col("doc_id") / DOCUMENTS_PER_FILE)).sortWithinPartitions("kind", "bucket", "token", "doc_id")
    spread.write.mode("overwrite").partitionBy("kind", "bucket").option("parquet.bloom.filter.enabled#token", "true").parquet(path)


def describe(spark: SparkSession, path: str, metadata_fields: tuple[str, ...], filters: bool = False) -> None:
    """Write the description of a stored index, which makes it one."""
    about = spark.createDataFrame([(VERSION, TOKEN_BUCKETS, list(metadata_fields), filters)], ABOUT_SCHEMA)
    about.coalesce(1).write.mode("overwrite").json(f"{path}/about")


class SearchIndex:
    """Postings and documents of a corpus, in memory as plans or on disk as Parquet."""

    def __init__(self, documents: DataFrame, postings: DataFrame, metadata_fields: tuple[str, ...] = (), source: tuple[DataFrame, IndexConfig] | None = None, stored: DataFrame | None = None, buckets: int = 0, filters: DataFrame | None = None) -> None:
        self.documents, self.postings, self.metadata_fields, self.source = documents, postings, tuple(metadata_fields), source
        self.stored, self.buckets, self.filters = stored, buckets, filters

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    @property
    def document_count(self) -> int:
        return self.documents.count()

    def document(self, doc_id: int) -> dict | None:
        """Stored fields of a document, or None if there is no such id."""
        row = self.documents.where(F.col("doc_id") == F.lit(doc_id)).first()
        return row.asDict() if row else None

    def tier(self, name: str) -> DataFrame:
        """Postings of a tier: lo for exact words and initials, hi for prefixes and title copies."""
        return self.postings.where(F.col("kind").isin(*(k for k in KINDS if (k in HIGH_TIER) == (name == "hi"))))

    def cache(self) -> SearchIndex:
        """Keep the postings in memory from the first search on."""
        self.postings.cache()
        self.source = self.stored = None
        return self

    def filter(self, name: str) -> DataFrame:
        """Stored compact filters of a tier (shard, shards, n, blob); IndexError_ if the index has none."""
        if self.filters is None:
            raise IndexError_("the index was saved without filters")
        return self.filters.where(F.col("tier") == name).drop("tier")

    def filter_search(self, query: str | None, max_results: int = 0) -> DataFrame:
        """rank, doc_id, hits, title_hits by the stored filters alone; IndexError_ if the index has none."""
        from glyphmill.operators.fuse import filter_search

        if self.filters is None:
            raise IndexError_("the index was saved without filters")
        return filter_search(self.documents, self.filters, query, max_results)

    def postings_for(self, kinds: set[str], tokens: set[str]) -> DataFrame:
        """Postings of these kinds and tokens. Of a corpus that isn't stored as an index, only texts that can hold one are tokenized."""
        postings_ = self.postings
        if self.stored is not None:
            folders = self.spark.range(1).select(F.array_distinct(F.array(*(token_bucket(F.lit(t), self.buckets) for t in sorted(tokens))))).first()[0] if tokens else []
            postings_ = self.stored.where(F.col("bucket").isin(*folders)).select("doc_id", "kind", "token")
        elif self.source:
            corpus, config = self.source
            postings_ = postings(corpus.where(can_hold(corpus, config, kinds, tokens)), config)
        return postings_.where(F.col("kind").isin(*kinds) & F.col("token").isin(*tokens))

    @staticmethod
    def stored_bytes(spark: SparkSession, path: str) -> int:
        """Bytes of a stored index's files."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return files.agg(F.sum("length")).first()[0] or 0

    def search(self, query: str, max_results: int = 0) -> DataFrame:
        from glyphmill.operators.search import search

        return search(self, query, max_results)

    def search_batch(self, queries: DataFrame) -> DataFrame:
        from glyphmill.operators.search import search_batch

        return search_batch(self, queries)

    def save(self, path: str, filters: bool = False) -> None:
        """Write documents, postings, the description and, if asked for, the compact filters of all postings."""
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        write_postings(self.postings, f"{path}/postings")
        if filters:
            from glyphmill.operators.fuse import build_filters, pair_keys

            written = self.spark.read.schema(STORED_SCHEMA).parquet(f"{path}/postings")
            build_filters(pair_keys(written).select("tier", "key")).write.mode("overwrite").parquet(f"{path}/filters")
        describe(self.spark, path, self.metadata_fields, filters)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SearchIndex:
        """Open a stored index; IndexError_ if there is none or it is of another version."""
        try:
            about = spark.read.schema(ABOUT_SCHEMA).json(f"{path}/about").first()
        except Exception as e:
            raise IndexError_(f"{path}: no index") from e
        if about is None or about["version"] is None:
            raise IndexError_(f"{path}: its description cannot be read")
        if about["version"] != VERSION:
            raise IndexError_(f"{path}: version {about['version']} instead of {VERSION}")
        stored = spark.read.schema(STORED_SCHEMA).parquet(f"{path}/postings")
        documents = spark.read.schema(DOCUMENT_SCHEMA).parquet(f"{path}/documents")
        filters = spark.read.schema(FILTER_SCHEMA).parquet(f"{path}/filters") if about["filters"] else None
        return cls(documents, stored.select("doc_id", "kind", "token"), tuple(about["metadata_fields"] or ()), None, stored, about["buckets"], filters)


def build_index(corpus: DataFrame, config: IndexConfig | None = None) -> SearchIndex:
    """Index of a corpus with doc_id and the configured fields; extra columns are ignored."""
    config = (config or IndexConfig()).checked()
    return SearchIndex(stored_documents(corpus, config), postings(corpus, config), config.metadata_fields, (corpus, config))
