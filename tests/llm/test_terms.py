"""Term frequencies and distinctiveness."""

import math
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import distinctive, termfreq
from glyphmill.operators.search import query_tokens

SCHEMA = "doc_id bigint, title string, body string, term string, tf int"
ROWS = [(0, "Alpha beta", "alpha ALPHA gamma", "x", 1), (70_000, None, "beta beta", "x", 1), (2, "", None, None, None), (-3, "delta", "alpha", "x", 1), (None, "omega", "alpha", "x", 1), (9, "z" * 30_000, "w " * 20_000, "x", 1)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def counts(rows):
    occurrences, records = Counter(), {}
    for i, title, body, *_ in rows:
        if i is not None:
            for t in query_tokens(title) + query_tokens(body):
                occurrences[t] += 1
                records.setdefault(t, set()).add(i)
    return {t: (n, len(records[t])) for t, n in occurrences.items()}


def test_frequencies(spark):
    got = {r.term: (r.occurrences, r.records) for r in termfreq.term_frequencies(table(spark), "doc_id", ["title", "body"]).collect()}
    assert got == counts(ROWS)


def test_repeated_ids_are_one_record(spark):
    rows = ROWS + ROWS[:2]
    got = {r.term: (r.occurrences, r.records) for r in termfreq.term_frequencies(table(spark, rows).repartition(3), "doc_id", ["title", "body"]).collect()}
    assert got == counts(rows) and got["beta"] == (6, 2)


def test_common_term_over_many_blocks(spark):
    df = spark.range(0, 150_000, 1, 5).selectExpr("id * 3 AS doc_id", "'the' AS title", "CASE WHEN id % 7 = 0 THEN 'seven the' END AS body")
    got = {r.term: (r.occurrences, r.records) for r in termfreq.term_frequencies(df, "doc_id", ["title", "body"]).collect()}
    assert got == {"the": (150_000 + 21_429, 150_000), "seven": (21_429, 21_429)}


def test_verdicts(spark):
    rows = [(i, "every", f"only{chr(97 + i)}" if i < 20 else "pair" if i < 22 else None, None, None) for i in range(100)]
    got = {r.term: r.verdict for r in termfreq.usefulness(table(spark, rows), "doc_id", ["title", "body"]).collect()}
    assert got["every"] == "common" and got["pair"] == "useful" and got["onlyc"] == "rare" and got["only"] if "only" in got else True
    five = [(i, "five" if i < 5 else "x", "six" if i < 6 else None, None, None) for i in range(100)]
    got = {r.term: r.verdict for r in termfreq.usefulness(table(spark, five), "doc_id", ["title", "body"]).collect()}
    assert got["five"] == "useful" and got["six"] == "common"


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 65_536])
def test_containers(n):
    ids = np.sort(np.random.default_rng(n).choice(1 << 16, n, replace=False)).astype(np.uint16)
    held = termfreq.container(ids)
    assert len(held) <= termfreq.BITMAP_BYTES and (termfreq.union([held, held]) == ids).all()
    other = np.arange(0, 1 << 16, 9, dtype=np.uint16)
    assert (termfreq.union([held, termfreq.container(other)]) == np.union1d(ids, other)).all()


def test_empty(spark):
    assert termfreq.usefulness(table(spark, []), "doc_id", ["title", "body"]).collect() == []
    assert distinctive.distinctiveness(table(spark, []), "doc_id", ["title", "body"]).collect() == []
    assert distinctive.distinctiveness(table(spark, [(1, None, "", None, None)]), "doc_id", ["title", "body"]).collect() == []


@pytest.mark.parametrize("hot", [20_000, 1])
def test_residuals(spark, monkeypatch, hot):
    monkeypatch.setattr(distinctive, "HOT_TERMS", hot)
    rows = [r for r in ROWS if r[0] != 9] + [ROWS[1]]
    cells = [Counter(query_tokens(t) + query_tokens(b)) for _, t, b, *_ in rows]
    column, n = sum(cells, Counter()), sum(sum(c.values()) for c in cells)
    expected = []
    for (i, *_), c in zip(rows, cells, strict=True):
        for term, tf in c.items():
            e = sum(c.values()) * column[term] / n
            z = (tf - e) / math.sqrt(e)
            expected.append((i, term, tf, sum(term in x for x in cells), e, z, z / math.sqrt((1 - sum(c.values()) / n) * (1 - column[term] / n))))
    got = distinctive.distinctiveness(table(spark, rows), "doc_id", ["title", "body"]).collect()
    key = lambda r: (str(r[0]), r[1])
    for g, e in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert g[:4] == e[:4] and g[4:] == pytest.approx(e[4:])


def test_own_subject_stands_above_common_words(spark):
    rows = [(i, f"subject{chr(97 + i)}", f"the place of subject{chr(97 + i)} and the town", None, None) for i in range(20)]
    got = distinctive.distinctiveness(table(spark, rows), "doc_id", ["title", "body"]).collect()
    for i in range(20):
        best = max((r for r in got if r.doc_id == i), key=lambda r: r.adjusted)
        assert best.term == f"subject{chr(97 + i)}"


def test_one_record_has_no_variance(spark):
    got = distinctive.distinctiveness(table(spark, [(1, "a b", None, None, None)]), "doc_id", ["title", "body"]).collect()
    assert {(r.term, r.residual, r.adjusted) for r in got} == {("a", 0.0, 0.0), ("b", 0.0, 0.0)}


def test_found_terms_are_scored(spark, data):
    from glyphmill.llm.queries import p2_found

    plan = p2_found(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("sqrt") >= 2
