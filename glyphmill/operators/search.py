"""Ranked search over postings.

A query's first 16 tokens are probes: each position looks for its token (or, if the token is made of initial consonants
only, for them), the last one also for words that begin with it, and every position for its title copy. One equi-join of
probes and postings and one aggregate give the score of a document: the positions that hit and those that hit a title are
bits of two masks, so a position counts once however it was met. Documents are ranked by hits, title hits and doc_id, and
stored fields are joined only to the rows that stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import INITIALS, LOWER, NGRAM_MAX, NGRAM_MIN, TOKEN_PATTERN, UPPER, is_initials, tokenize

MAX_TOKENS = 16
DEFAULT_RESULTS = 20
#: Probe rows up to which the probe side is broadcast; a larger batch is joined by shuffle, and by merging: Spark would else
#: broadcast it by the size of the queries, of which each is up to (2 * MAX_TOKENS + 1) * SALTS probe rows.
BROADCAST_PROBES = 500_000
#: Shares of a token's postings in that join, by document, so a word of most documents is no single task.
SALTS = 32

_PY_PATTERN = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", TOKEN_PATTERN))
_LOWER = str.maketrans(UPPER, LOWER)
_INITIALS = re.compile(f"[{INITIALS}]+")

PROBE_SCHEMA = "pos int, kind string, token string, is_title boolean"


def query_tokens(query: str | None) -> list[str]:
    """Tokens of one query, in order, with repeats."""
    return _PY_PATTERN.findall((query or "").translate(_LOWER))


def probes_of(query: str | None) -> list[tuple[int, str, str, bool]]:
    """(pos, kind, token, is_title) of one query."""
    tokens = query_tokens(query)[:MAX_TOKENS]
    out = []
    for pos, token in enumerate(tokens):
        marked = bool(_INITIALS.fullmatch(token))
        out += [(pos, "cho" if marked else "exact", token, False), (pos, "title_cho" if marked else "title", token, True)]
        if pos == len(tokens) - 1 and not marked and NGRAM_MIN <= len(token) <= NGRAM_MAX:
            out.append((pos, "prefix", token, False))
    return out


def probe_table(queries: DataFrame) -> DataFrame:
    """query_id, pos, kind, token, is_title for every query of a batch (query_id, query)."""
    tokens = queries.select("query_id", F.slice(tokenize(F.col("query")), 1, MAX_TOKENS).alias("tokens"))
    each = tokens.select("query_id", (F.size("tokens") - 1).alias("last"), F.posexplode("tokens").alias("pos", "token"))
    marked = is_initials(F.col("token"))
    kind = lambda plain, cho: F.when(marked, cho).otherwise(plain)
    probe = lambda kind_, title: F.struct(kind_.alias("kind"), F.lit(title).alias("is_title"))
    starts = (F.col("pos") == F.col("last")) & ~marked & F.length("token").between(NGRAM_MIN, NGRAM_MAX)
    rows = F.array(probe(kind("exact", "cho"), False), probe(kind("title", "title_cho"), True), F.when(starts, probe(F.lit("prefix"), False)))
    return each.select("query_id", "pos", "token", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("query_id", "pos", "r.kind", "token", "r.is_title")


def scores(matches: DataFrame, keys: list[str]) -> DataFrame:
    bit = F.expr("shiftleft(1, pos)")
    masks = matches.groupBy(*keys).agg(F.bit_or(F.when(~F.col("is_title"), bit).otherwise(0)).alias("hit"), F.bit_or(F.when(F.col("is_title"), bit).otherwise(0)).alias("titled"))
    counted = masks.select(*keys, F.bit_count("hit").cast("bigint").alias("hits"), F.bit_count(F.col("hit").bitwiseAND(F.col("titled"))).cast("bigint").alias("title_hits"))
    return counted.where("hits >= 1")


def _order() -> list[Column]:
    return [F.desc("hits"), F.desc("title_hits"), F.asc("doc_id")]


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """rank, doc_id, hits, title_hits of the `limit` best documents of one query."""
    best = scored.orderBy(*_order()).limit(limit)
    return best.select(F.row_number().over(Window.orderBy(*_order())).cast("bigint").alias("rank"), "doc_id", "hits", "title_hits")  # over `limit` rows


def search(index, query: str | None, max_results: int = 0) -> DataFrame:
    """rank, doc_id, hits, title_hits, title, url, meta of the best documents for one query; none for a query without tokens."""
    probes = probes_of(query)
    spark, limit = index.spark, max_results or DEFAULT_RESULTS
    table = F.broadcast(spark.createDataFrame(probes, PROBE_SCHEMA))  # at most 33 rows
    postings = index.postings_for({p[1] for p in probes}, {p[2] for p in probes}) if probes else index.postings.limit(0)
    best = ranked(scores(postings.join(table, ["kind", "token"]), ["doc_id"]), limit)
    kept = F.broadcast(best) if limit <= 10_000 else best
    return index.documents.join(kept, "doc_id").select("rank", "doc_id", "hits", "title_hits", "title", "url", "meta").orderBy("rank")


def score_batch(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, doc_id, hits, title_hits: the best documents of every query (query_id, query, max_results)."""
    probes = probe_table(queries)
    facts = queries.agg(F.count("*").alias("n"), F.max("max_results").alias("most")).first()
    few = facts["n"] * (2 * MAX_TOKENS + 1) <= BROADCAST_PROBES
    if few:
        met = postings.join(F.broadcast(probes), ["kind", "token"])
    else:
        shared = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = postings.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(shared.hint("merge"), ["kind", "token", "salt"])
    scored = scores(met, ["query_id", "doc_id"])
    wanted = queries.select("query_id", F.when(F.col("max_results") > 0, F.col("max_results")).otherwise(DEFAULT_RESULTS).alias("wanted"))
    placed = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order())))
    placed = placed.where(F.col("rank") <= max(facts["most"] or 0, DEFAULT_RESULTS))  # a literal bound lets partial ranking drop rows early
    kept = placed.join(F.broadcast(wanted) if few else wanted.hint("merge"), "query_id").where("rank <= wanted")
    return kept.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "hits", "title_hits")


def search_batch(index, queries: DataFrame) -> DataFrame:
    """score_batch with the stored fields of the documents that stay."""
    return score_batch(index.postings, queries).join(index.documents, "doc_id").select("query_id", "rank", "doc_id", "hits", "title_hits", "title", "url", "meta")


def results_json(results: DataFrame) -> DataFrame:
    """Results as JSON texts, one a row."""
    return results.select(F.to_json(F.struct("*")).alias("result"))
