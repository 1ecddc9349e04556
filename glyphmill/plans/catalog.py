"""Queries of the search operators over the test tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.config import ConfigError, IndexConfig
from glyphmill.functions import text
from glyphmill.operators import evaluate, fuse
from glyphmill.operators.index import SearchIndex, build_index, postings, pretokenized_postings, tier, words
from glyphmill.operators.search import probe_table
from glyphmill.operators.tables import cut_lineage, read_table
from glyphmill.plans import oracle as o
from glyphmill.sources.stopwords import DEFAULT_STOPWORDS, parse_lines

BOTH = IndexConfig(indexed_fields=("title", "body"), metadata_fields=("author", "date_text", "views"))
PLAIN_STOP = IndexConfig(indexed_fields=("title", "body"), stopwords=DEFAULT_STOPWORDS)
BY_PATH = IndexConfig(indexed_fields=("title", "body"), metadata_fields=("path",), url_field="path")

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "search_index")


def small(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(o.SMALL_CORPUS, "doc_id bigint, title string, url string, body string, author string, date_text string")


def _exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(*(F.coalesce(text.tokenize(F.col(c)), F.array().cast("array<string>")) for c in ("title", "body")))
    return corpus(spark, sf_dir).select("doc_id", F.explode(both).alias("w"))


_ALL = f"(SELECT doc_id, unnest({o.tok('title')}) AS w FROM search_index UNION ALL SELECT doc_id, unnest({o.tok('body')}) FROM search_index)"


# Tokens and words


@query(f"SELECT w AS token, count(*) AS n FROM {_ALL} GROUP BY ALL")
def token_counts(spark, sf_dir):
    return _exploded(spark, sf_dir).groupBy(F.col("w").alias("token")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, len({o.tok('text')})::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def tokens_per_doc(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(text.tokenize(F.col("text"))).cast("bigint").alias("n"))


@query(f"SELECT {o.GROUP_CASE} AS script_group, count(*) AS n FROM {_ALL} GROUP BY ALL")
def script_group_counts(spark, sf_dir):
    return _exploded(spark, sf_dir).groupBy(text.script_group(F.col("w")).alias("script_group")).agg(F.count("*").alias("n"))


def _words(spark, sf_dir, config):
    lists = words(corpus(spark, sf_dir), config)
    flagged = F.transform("all", lambda w: F.struct(w.alias("word"), F.array_contains(F.col("title"), w).alias("is_title")))
    return lists.select("doc_id", F.inline(flagged))


@query(f"WITH {o.words()} SELECT doc_id, w AS word, is_title FROM words")
def distinct_words(spark, sf_dir):
    return _words(spark, sf_dir, BOTH)


@query(f"WITH {o.words(stopwords=True)} SELECT doc_id, w AS word, is_title FROM words")
def stopword_filtered_words(spark, sf_dir):
    return _words(spark, sf_dir, PLAIN_STOP)


@query(f"SELECT DISTINCT translate(trim(line, ' ' || chr(9) || chr(13)), '{text.UPPER}', '{text.LOWER}') AS word FROM stopword_lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' AND NOT starts_with(trim(line, ' ' || chr(9) || chr(13)), '#')")
def stopword_list(spark, sf_dir):
    return parse_lines(read_table(spark, sf_dir, "stopword_lines"), "line")


@query(f"SELECT * FROM (VALUES {o.STOPWORD_VALUES}) v(word)")
def default_stopwords(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in DEFAULT_STOPWORDS], "word string")


# Expansion


@query(f"WITH {o.words()} SELECT DISTINCT w AS word, substr(w, 1, k) AS token FROM words, (SELECT unnest(range(2, 9)) AS k) WHERE is_title AND k < length(w)")
def edge_ngrams_title(spark, sf_dir):
    titles = words(corpus(spark, sf_dir), BOTH).select(F.explode("title").alias("word")).distinct()
    return titles.select("word", F.explode(text.edge_ngrams(F.col("word"))).alias("token"))


@query(f"WITH {o.words()} SELECT DISTINCT w AS word, {o.jamo('w')} AS initials FROM words WHERE w SIMILAR TO '.*[가-힣].*'")
def initials_syllables(spark, sf_dir):
    each = _words(spark, sf_dir, BOTH).select("word").distinct()
    return each.select("word", text.initials(F.col("word")).alias("initials")).where("initials <> ''")


@query(f"WITH {o.words()}, {o.postings()} SELECT doc_id, token FROM post WHERE kind = 'cho' AND length(token) > 1")
def initials_prefixes(spark, sf_dir):
    return postings(corpus(spark, sf_dir), BOTH).where("kind = 'cho' AND char_length(token) > 1").select("doc_id", "token")


@query(f"WITH {o.words()}, {o.postings()} SELECT doc_id, token FROM post WHERE kind = 'cho' AND length(token) = 1")
def initials_title_single(spark, sf_dir):
    return postings(corpus(spark, sf_dir), BOTH).where("kind = 'cho' AND char_length(token) = 1").select("doc_id", "token")


@query(f"WITH {o.words()}, {o.postings()} SELECT doc_id, kind, token FROM post WHERE kind IN ('title', 'title_cho')")
def title_marked_tokens(spark, sf_dir):
    return postings(corpus(spark, sf_dir), BOTH).where("kind IN ('title', 'title_cho')")


# Postings and stored fields


@query(f"WITH {o.words()}, {o.postings()} SELECT * FROM post")
def postings_all(spark, sf_dir):
    return postings(corpus(spark, sf_dir), BOTH)


@query(f"WITH {o.words(stopwords=True)}, {o.postings()} SELECT kind, count(*) AS n, count(DISTINCT token) AS tokens FROM post GROUP BY ALL")
def postings_by_kind(spark, sf_dir):
    return postings(corpus(spark, sf_dir), PLAIN_STOP).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("token").alias("tokens"))


@query(f"WITH {o.words()}, {o.postings()} SELECT CASE WHEN kind IN ('exact', 'cho') THEN 'lo' ELSE 'hi' END AS tier, count(*) AS n FROM post GROUP BY ALL")
def postings_tier_counts(spark, sf_dir):
    return postings(corpus(spark, sf_dir), BOTH).groupBy(tier(F.col("kind")).alias("tier")).agg(F.count("*").alias("n"))


@query(f"WITH {o.words(o.SMALL)}, {o.postings()} SELECT * FROM post")
def golden_postings(spark, sf_dir):
    return postings(small(spark), BOTH)


@query(
    f"""WITH words AS (SELECT DISTINCT doc_id, w, false AS is_title FROM (SELECT doc_id, unnest(tokens) AS w FROM pretokenized) WHERE w IS NOT NULL), {o.postings()}
SELECT * FROM post WHERE kind IN ('exact', 'cho')"""
)
def postings_pretokenized(spark, sf_dir):
    return pretokenized_postings(read_table(spark, sf_dir, "pretokenized"), "tokens")


@query("SELECT doc_id, coalesce(title, '') AS title, coalesce(url, '') AS url, coalesce(author, '') AS author, coalesce(date_text, '') AS date_text, coalesce(views::VARCHAR, '') AS views FROM search_index")
def stored_fields(spark, sf_dir):
    documents = build_index(corpus(spark, sf_dir), BOTH).documents
    return documents.select("doc_id", "title", "url", *(F.element_at("meta", f).alias(f) for f in BOTH.metadata_fields))


@query("SELECT doc_id, coalesce(title, '') AS title, coalesce(path, '') AS url FROM search_index")
def stored_by_path(spark, sf_dir):
    return build_index(corpus(spark, sf_dir), BY_PATH).documents.select("doc_id", "title", "url")


# Lists and switches of a raw configuration, by SQL over its JSON.
_LIST = "CASE WHEN json_type(j, '$.schema.{0}') = 'ARRAY' THEN array_to_string(list_transform(json_extract(j, '$.schema.{0}[*]'), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' ELSE '' END), ',') ELSE '{1}' END"
_CONFIGS = f"""WITH c AS (SELECT config_id, CASE WHEN json_valid(config_json) THEN config_json::JSON END AS j FROM index_config),
s AS (SELECT config_id, j, {_LIST.format('indexed_fields', 'title')} AS indexed, {_LIST.format('metadata_fields', '')} AS metadata, {_LIST.format('prefix_fields', 'title')} AS prefix,
  CASE WHEN json_type(j, '$.schema.url_field') = 'VARCHAR' THEN j->>'$.schema.url_field' ELSE 'url' END AS url_field,
  CASE WHEN json_type(j, '$.korean.choseong_max_len') IN ('UBIGINT', 'BIGINT') THEN (j->>'$.korean.choseong_max_len')::INTEGER WHEN (j->>'$.korean.choseong_search') = 'false' THEN 0 ELSE 3 END AS initials_max_len FROM c),
e AS (SELECT *, CASE WHEN j IS NULL THEN 'ConfigError' WHEN NOT list_has_all(string_split(indexed, ','), string_split(prefix, ',')) THEN 'PrefixFieldNotIndexed' END AS error FROM s)
SELECT config_id, error, {', '.join(f"CASE WHEN error IS NULL THEN {c} END AS {c}" for c in ('indexed', 'metadata', 'prefix', 'url_field', 'initials_max_len'))} FROM e"""


@query(_CONFIGS)
def config_settings(spark, sf_dir):
    """What each raw configuration sets, or why it cannot be used."""
    rows = []
    for r in read_table(spark, sf_dir, "index_config").orderBy("config_id").collect():  # a fixed table of configurations
        try:
            c = IndexConfig.from_json(r.config_json).checked()
            rows.append((r.config_id, ",".join(c.indexed_fields), ",".join(c.metadata_fields), ",".join(c.prefix_fields), c.url_field, c.initials_max_len, None))
        except ConfigError as e:
            rows.append((r.config_id, None, None, None, None, None, type(e).__name__))
    return spark.createDataFrame(rows, "config_id bigint, indexed string, metadata string, prefix string, url_field string, initials_max_len int, error string")


# Search


@query(f"WITH {o.probes('search_queries')} SELECT * FROM probe")
def query_analysis(spark, sf_dir):
    return probe_table(read_table(spark, sf_dir, "search_queries"))


_RESULT = "SELECT rank, doc_id, hits, title_hits, coalesce(title, '') AS title, coalesce(url, '') AS url FROM best JOIN search_index USING (doc_id)"


def _search(name: str, text_: str, max_results: int = 0, config: IndexConfig = BOTH) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build_index(corpus(spark, sf_dir), config).search(text_, max_results).select("rank", "doc_id", "hits", "title_hits", "title", "url")

    run.__name__ = name
    query(o.search(o.one(text_, max_results), _RESULT, stopwords=config.stopwords is not None))(run)


_search("search_single", "harbour")
_search("search_or", "the of")
_search("search_missing_token", "bridge zqzqnowhere")
_search("search_no_result", "zqzqnowhere")
_search("search_empty", " ... ")
_search("search_prefix_last", "bridge known Vel")
_search("search_prefix_not_last", "Vel bridge known")
_search("search_title_boost", "bridge of")
_search("search_initials", "ㄱㅅ")
_search("search_initials_mixed", "harbour ㅎ")
_search("search_initials_too_long", "ㄱㅅㄷㄴ")
_search("search_token_cap", "the of in a is and by to at for on near known lies north its kes", 50)
_search("search_repeated_token", "the the the bridge")
_search("search_topk", "the", 7)
_search("search_default_20", "a")
_search("search_all_matches", "bridge", 1_000_000)
_search("search_stopword_last_prefix", "the", 0, PLAIN_STOP)
_search("search_accents", "forêt École É")
_search("search_han", "学校 图书馆 の")


@query(
    o.search(
        o.one("known harbour", 30),
        "SELECT rank, doc_id, coalesce(author, '') AS author, coalesce(date_text, '') AS date_text, coalesce(views::VARCHAR, '') AS views FROM best JOIN search_index USING (doc_id)",
    )
)
def search_with_meta(spark, sf_dir):
    found = build_index(corpus(spark, sf_dir), BOTH).search("known harbour", 30)
    return found.select("rank", "doc_id", *(F.element_at("meta", f).alias(f) for f in BOTH.metadata_fields))


@query(
    o.search(
        o.one("known harbour", 30),
        "SELECT row_number() OVER (ORDER BY coalesce(date_text, ''), doc_id) AS place, doc_id, coalesce(date_text, '') AS date_text FROM best JOIN search_index USING (doc_id)",
    )
)
def search_sorted_by_meta(spark, sf_dir):
    from pyspark.sql import Window

    found = build_index(corpus(spark, sf_dir), BOTH).search("known harbour", 30).select("doc_id", F.element_at("meta", "date_text").alias("date_text"))
    return found.withColumn("place", F.row_number().over(Window.orderBy("date_text", "doc_id")).cast("bigint"))  # over the 30 results


@query(o.search("SELECT query_id, query, max_results FROM search_queries", "SELECT query_id, rank, doc_id, hits, title_hits, coalesce(title, '') AS title, coalesce(url, '') AS url FROM best JOIN search_index USING (doc_id)"))
def search_batch(spark, sf_dir):
    found = build_index(corpus(spark, sf_dir), BOTH).search_batch(read_table(spark, sf_dir, "search_queries"))
    return found.drop("meta")


_GOLDEN = [(0, "hello", 0), (1, "안녕", 0), (2, "hel", 0), (3, "progr", 0), (4, "ㅎ", 0), (5, "ㅇ", 0), (6, "ㅇㄴ", 0), (7, "hello world", 0), (8, "hello programming", 0), (9, "hello zzznonexistentzzz", 0), (10, "quern", 2), (11, "", 0), (12, "zzznonexistentzzz", 0), (13, " ".join(["hello"] * 16), 0)]
_GOLDEN_SQL = "SELECT * FROM (VALUES " + ", ".join(str(g) for g in _GOLDEN) + ") v(query_id, query, max_results)"


@query(o.search(_GOLDEN_SQL, "SELECT query_id, rank, title, hits, title_hits FROM best JOIN small USING (doc_id)", corpus=o.SMALL, tail=f", small AS {o.SMALL}"))
def golden_searches(spark, sf_dir):
    index = build_index(small(spark), BOTH)
    return index.search_batch(spark.createDataFrame(_GOLDEN, "query_id int, query string, max_results int")).select("query_id", "rank", "title", "hits", "title_hits")


@query(
    """SELECT log.query_id, count(DISTINCT log_id) AS shown, count(DISTINCT session_key) AS sessions, count(DISTINCT log_id) FILTER (log.doc_id IS NULL) AS without_result,
  count(DISTINCT log_id) FILTER (log.rank_no = 1) AS first_places FROM search_log log GROUP BY ALL"""
)
def search_log_summary(spark, sf_dir):
    once = read_table(spark, sf_dir, "search_log").dropDuplicates(["log_id"])
    counts = once.groupBy("query_id").agg(
        F.count("*").alias("shown"), F.countDistinct("session_key").alias("sessions"), F.count_if(F.col("doc_id").isNull()).alias("without_result"), F.count_if(F.coalesce(F.col("rank_no") == 1, F.lit(False))).alias("first_places")
    )
    return counts


# Evaluation


def _index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return build_index(corpus(spark, sf_dir), PLAIN_STOP)


@query(f"WITH {o.NEUTRAL} SELECT token, df FROM freq")
def doc_frequency(spark, sf_dir):
    return evaluate.document_frequency(corpus(spark, sf_dir))


@query(f"WITH {o.NEUTRAL} SELECT token, stratum FROM sample")
def vocab_sample(spark, sf_dir):
    return evaluate.vocabulary_sample(evaluate.document_frequency(corpus(spark, sf_dir)))


@query(f"WITH {o.NEUTRAL} SELECT doc_id, url, query FROM known")
def known_items(spark, sf_dir):
    return evaluate.known_items(corpus(spark, sf_dir))


@query(
    o.evaluation(
        "SELECT token AS query FROM sample",
        20,
        """, urls AS (SELECT DISTINCT token AS query, url FROM held WHERE token IN (SELECT token FROM sample)), sizes AS (SELECT query, count(*) AS size FROM urls GROUP BY ALL),
each AS (SELECT query, count(*) AS got, count(*) FILTER (EXISTS (SELECT 1 FROM urls u WHERE u.query = got.query AND u.url = got.url)) AS hit FROM got GROUP BY ALL)
SELECT count(*) AS queries, round(avg(coalesce(hit, 0) / least(size, 20)), 6) AS recall, round(avg(hit / got), 6) AS precision FROM sizes LEFT JOIN each USING (query)""",
    )
)
def eval_recall_precision(spark, sf_dir):
    return evaluate.recall_precision(_index(spark, sf_dir), corpus(spark, sf_dir))


@query(
    o.evaluation(
        "SELECT query FROM (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(evaluate.negative_tokens())) + ") v(i, query) WHERE query NOT IN (SELECT token FROM freq) ORDER BY i LIMIT 200)",
        20,
        "SELECT 200::BIGINT AS queries, count(*) AS returned, round(count(*) / (200.0 * (SELECT count(*) FROM search_index)), 6)::DOUBLE AS fp_rate FROM got",
    )
)
def eval_negative(spark, sf_dir):
    return evaluate.negative_rate(_index(spark, sf_dir), corpus(spark, sf_dir))


@query(
    o.evaluation(
        "SELECT query FROM known",
        10,
        "SELECT count(*) AS items, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM known LEFT JOIN (SELECT query, url, min(rank) AS rank FROM got GROUP BY ALL) USING (query, url)",
    )
)
def eval_mrr(spark, sf_dir):
    return evaluate.mean_reciprocal_rank(_index(spark, sf_dir), corpus(spark, sf_dir))


_HEADS = rf"""SELECT doc_id, url, {o.jamo("substr(syllables, 1, least(3, length(word)))")} AS query FROM (
  SELECT doc_id, url, word, regexp_extract(word, '^[가-힣]*') AS syllables FROM (
    SELECT doc_id, coalesce(url, '') AS url, list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\p{{L}}\p{{N}}]+'), lambda t: regexp_full_match(t, '\p{{Hangul}}+'))[1] AS word FROM search_index))
  WHERE word IS NOT NULL AND length(syllables) >= least(3, length(word))"""


@query(_HEADS)
def initials_queries(spark, sf_dir):
    return evaluate.initials_queries(corpus(spark, sf_dir))


@query(o.evaluation(f"SELECT query FROM ({_HEADS})", 20, f"SELECT count(*) AS tried, count(rank) AS found FROM ({_HEADS}) LEFT JOIN (SELECT query, url, min(rank) AS rank FROM got GROUP BY ALL) USING (query, url)"))
def eval_initials(spark, sf_dir):
    return evaluate.initials_retrieval(_index(spark, sf_dir), corpus(spark, sf_dir))


# Compact filters


@query()
def pair_keys(spark, sf_dir):
    return fuse.pair_keys(postings(corpus(spark, sf_dir), BOTH))


@query(f"WITH {o.words()}, {o.postings()} SELECT CASE WHEN kind IN ('exact', 'cho') THEN 'lo' ELSE 'hi' END AS tier, count(*) AS keys FROM post GROUP BY ALL")
def filter_keys(spark, sf_dir):
    return fuse.filter_statistics(postings(corpus(spark, sf_dir), BOTH)).select("tier", "keys")


_SLOTS = "((greatest(1, ceil(round(keys * greatest(1.125, 0.875 + 0.25 * ln(1e6) / ln(keys))) / seg) - 2) + 2) * seg)"


@query(
    f"""WITH {o.words()}, {o.postings()}, n AS (SELECT CASE WHEN kind IN ('exact', 'cho') THEN 'lo' ELSE 'hi' END AS tier, count(*) AS keys FROM post GROUP BY ALL),
s AS (SELECT *, least(262144, 2 ** floor(ln(keys) / ln(3.33) + 2.25)) AS seg FROM n)
SELECT tier, keys, (24 + ceil({_SLOTS} * CASE WHEN tier = 'lo' THEN 9 ELSE 16 END / 8))::BIGINT AS bytes FROM s"""
)
def filter_sizes(spark, sf_dir):
    return fuse.filter_statistics(postings(corpus(spark, sf_dir), BOTH))


@query(f"WITH {o.words()}, {o.postings()} SELECT CASE WHEN kind IN ('exact', 'cho') THEN 'lo' ELSE 'hi' END AS tier, true AS held, count(*) AS n FROM post GROUP BY ALL")
def filter_membership(spark, sf_dir):
    """Every stored posting is held by its filter."""
    keys = cut_lineage(fuse.pair_keys(postings(corpus(spark, sf_dir), BOTH)).select("tier", "key"))
    return fuse.probe(keys, fuse.build_filters(keys)).groupBy("tier", "held").agg(F.count("*").alias("n"))


def _filtered(spark, sf_dir, limit):
    index = build_index(corpus(spark, sf_dir), BOTH)
    filters = fuse.build_filters(cut_lineage(fuse.pair_keys(index.postings).select("tier", "key")))
    return index, fuse.filter_search(index.documents, filters, "bridge known Vel", limit)


@query()
def filter_search(spark, sf_dir):
    """The best documents by the filters alone."""
    return _filtered(spark, sf_dir, 50)[1]


@query(o.search(o.one("bridge known Vel", 1_000_000), "SELECT doc_id, hits, title_hits FROM best"))
def filter_search_covers(spark, sf_dir):
    """The exact results that the search by filters has too, with as many hits or more: all of them."""
    index, found = _filtered(spark, sf_dir, 1_000_000)
    exact = index.search("bridge known Vel", 1_000_000).select("doc_id", "hits", "title_hits")
    more = found.select("doc_id", F.col("hits").alias("more"), F.col("title_hits").alias("more_titles"))
    return exact.join(more, "doc_id").where("more >= hits AND more_titles >= title_hits").select("doc_id", "hits", "title_hits")
