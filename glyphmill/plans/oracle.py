"""DuckDB SQL fragments from which the queries' SQL checks are put together; none uses Spark's plans."""

from __future__ import annotations

from glyphmill.sources.stopwords import DEFAULT_STOPWORDS

# Fixed values, written for RE2 and apart from the operators': letters, initial consonants, and the script groups with the marks that join them.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
GROUPS = {
    "latin": "A-Za-zÀ-ÖØ-öø-ʯḀ-ỿ",
    "hangul": "가-힣ᄀ-ᇿ\u3130-\u318f\uffa0-\uffdc",
    "han": "一-\u9fff㐀-䶿\uf900-\ufaff\U00020000-\U0002ffff",
    "hiragana": "\u3040-ゟ",
    "katakana": "゠-ヿㇰ-ㇿ･-ﾟ",
    "number": "0-9０-９",
}
MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
TOKEN_PATTERN = "|".join(f"[{body}][{body}{MARKS}]*" for body in GROUPS.values())


def tok(x: str) -> str:
    return f"regexp_extract_all(translate({x}, '{UPPER}', '{LOWER}'), '{TOKEN_PATTERN}')"


def jamo(x: str) -> str:
    """Initial consonants of a word."""
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[가-힣]'), lambda c: substr('{INITIALS}', ((unicode(c) - 44032) // 588)::INTEGER + 1, 1)), '')"


STOPWORD_VALUES = ", ".join(f"('{w}')" for w in DEFAULT_STOPWORDS)

#: A small corpus whose results are known, with a configuration of title and body, author and date.
SMALL_CORPUS = [
    (0, "Hello World", "/hello", "hello world programming quern", "alice", "2026-01-15"),
    (1, "Zig Programming", "/zig", "zig wasm fast quern", "bob", "2026-02-20"),
    (2, "안녕하세요", "/annyeong", "안녕하세요 친구 한글 quern", "charlie", "2026-03-10"),
    (3, "Hello 안녕", "/mixed", "hello 안녕 world quern", "alice", "2026-01-05"),
    (4, "Empty Body", "/empty", "quern", "dave", "2026-04-01"),
]
SMALL = "(SELECT * FROM (VALUES " + ", ".join(str(r) for r in SMALL_CORPUS) + ") v(doc_id, title, url, body, author, date_text))"


def words(corpus: str = "search_index", stopwords: bool = False, fields: tuple[str, ...] = ("title", "body")) -> str:
    """CTE words(doc_id, w, is_title)."""
    each = " UNION ALL ".join(f"SELECT doc_id, unnest({tok(f)}) AS w, {'true' if f == 'title' else 'false'} AS t FROM {corpus}" for f in fields)
    where = f"WHERE w NOT IN (SELECT * FROM (VALUES {STOPWORD_VALUES}))" if stopwords else ""
    return f"words AS (SELECT doc_id, w, bool_or(t) AS is_title FROM ({each}) {where} GROUP BY ALL)"


def postings(max_len: int = 3) -> str:
    """CTE post(doc_id, kind, token) over words, with title as the prefix field."""
    js = f"(SELECT doc_id, is_title, {jamo('w')} AS j FROM words WHERE w SIMILAR TO '.*[가-힣].*')"
    ks = f"(SELECT unnest(range(1, {max_len} + 1)) AS k)"
    return f"""post AS (
  SELECT doc_id, 'exact' AS kind, w AS token FROM words
  UNION SELECT doc_id, 'title', w FROM words WHERE is_title
  UNION SELECT doc_id, 'prefix', substr(w, 1, k) FROM words, (SELECT unnest(range(2, 9)) AS k) WHERE is_title AND k < length(w)
  UNION SELECT doc_id, 'cho', substr(j, 1, k) FROM {js}, {ks} WHERE k <= length(j) AND (is_title OR k > 1)
  UNION SELECT doc_id, 'title_cho', substr(j, 1, k) FROM {js}, {ks} WHERE k <= length(j) AND is_title)"""


def probes(queries: str) -> str:
    """CTEs qt and probe(query_id, pos, kind, token, is_title) over queries(query_id, query)."""
    marked = f"regexp_full_match(t, '[{INITIALS}]+')"
    return f"""qt AS (SELECT query_id, unnest(ts) AS t, unnest(range(0, len(ts))) AS pos, len(ts) AS n FROM (SELECT query_id, {tok('query')}[1:16] AS ts FROM {queries})),
probe AS (
  SELECT query_id, pos::INTEGER AS pos, CASE WHEN {marked} THEN 'cho' ELSE 'exact' END AS kind, t AS token, false AS is_title FROM qt
  UNION ALL SELECT query_id, pos::INTEGER, CASE WHEN {marked} THEN 'title_cho' ELSE 'title' END, t, true FROM qt
  UNION ALL SELECT query_id, pos::INTEGER, 'prefix', t, false FROM qt WHERE pos = n - 1 AND NOT {marked} AND length(t) BETWEEN 2 AND 8)"""


RANKED = """hit AS (SELECT DISTINCT query_id, pos, doc_id FROM probe JOIN post USING (kind, token) WHERE NOT is_title),
titled AS (SELECT DISTINCT query_id, pos, doc_id FROM probe JOIN post USING (kind, token) WHERE is_title),
score AS (SELECT query_id, doc_id, count(*) AS hits, count(titled.pos) AS title_hits FROM hit LEFT JOIN titled USING (query_id, pos, doc_id) GROUP BY ALL),
ranked AS (SELECT query_id, doc_id, hits, title_hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, title_hits DESC, doc_id) AS rank FROM score)"""


def search(query_values: str, select: str, corpus: str = "search_index", stopwords: bool = False, tail: str = "", max_len: int = 3) -> str:
    """Ranked search for queries given as SQL for q(query_id, query, max_results); `select` is over ranked."""
    return f"""WITH q AS ({query_values}), {words(corpus, stopwords)}, {postings(max_len)}, {probes('q')}, {RANKED},
best AS (SELECT ranked.* FROM ranked JOIN q USING (query_id) WHERE rank <= CASE WHEN max_results > 0 THEN max_results ELSE 20 END){tail}
{select}"""


def one(query: str, max_results: int = 0) -> str:
    return f"SELECT 0 AS query_id, '{query}' AS query, {max_results} AS max_results"


GROUP_CASE = "CASE " + " ".join(f"WHEN regexp_matches(w, '^[{body}]') THEN '{name}'" for name, body in GROUPS.items()) + " END"

#: CTEs of the evaluation: neutral tokens, truth and frequencies.
NEUTRAL = r"""held AS (SELECT DISTINCT doc_id, coalesce(url, '') AS url, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[\p{L}\p{N}]+')) AS token FROM search_index),
freq AS (SELECT token, count(*) AS df FROM held GROUP BY ALL),
vocab AS (SELECT token, CASE WHEN regexp_matches(token, '\p{Hangul}') THEN 'hangul' ELSE 'other' END AS stratum FROM freq WHERE length(token) BETWEEN 2 AND 12),
placed AS (SELECT token, stratum, row_number() OVER (PARTITION BY stratum ORDER BY token) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY stratum) // 60) AS step FROM vocab),
sample AS (SELECT token, stratum FROM placed WHERE i % step = 0 AND i // step < 60),
known AS (SELECT doc_id, url, token AS query FROM (
  SELECT doc_id, url, token, row_number() OVER (PARTITION BY doc_id ORDER BY df, length(token) DESC, token) AS r
  FROM (SELECT DISTINCT doc_id, coalesce(url, '') AS url, unnest(regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}]+')) AS token FROM search_index) JOIN freq USING (token) WHERE length(token) >= 2) WHERE r = 1)"""


def evaluation(asked: str, limit: int, select: str) -> str:
    """Batch search for the distinct texts of `asked` (a query with one column, query), then `select` over got(query, url, rank)."""
    return f"""WITH {NEUTRAL}, q AS (SELECT query AS query_id, query FROM (SELECT DISTINCT query FROM ({asked}))), {words(stopwords=True)}, {postings()}, {probes('q')}, {RANKED},
got AS (SELECT query_id AS query, rank, doc_id, coalesce(url, '') AS url FROM ranked JOIN search_index USING (doc_id) WHERE rank <= {limit})
{select}"""
