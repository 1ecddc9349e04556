"""DuckDB SQL for those queries of this subpackage that SQL can express, written without the operators' methods and values."""

from __future__ import annotations

from glyphmill.plans.oracle import LOWER, TOKEN_PATTERN, UPPER

TOKENS = f"""tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '{TOKEN_PATTERN}')) AS term
  FROM (SELECT doc_id, title AS t FROM search_index UNION ALL SELECT doc_id, body FROM search_index)
)"""

MARGINS = f"""{TOKENS}, cells AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
  row_totals AS (SELECT doc_id, sum(tf) AS r FROM cells GROUP BY ALL),
  column_totals AS (SELECT term, sum(tf) AS c, count(*) AS records FROM cells GROUP BY ALL),
  total AS (SELECT count(*)::DOUBLE AS n FROM tokens)"""

WHITE = r"[ \t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

# The classes of characters that read like others.
DEVIATING = r"[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF66}-\x{FF9F}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{AD}\x{61C}\x{180E}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}]"
JOINED_EMOJI = r"[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}]\x{FE0F}?\x{200D}"



# Half-width kana and their ordinary forms, and look-alikes with their Latin letters.
HALF_KANA = ("ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ", "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\u3099\u309a")
CYRILLIC, CYRILLIC_AS_LATIN = "АВЕКМНОРСТУХЅІЈԚԜаеорсухѕіјһԁԛԝ", "ABEKMHOPCTYXSIJQWaeopcyxsijhdqw"
GREEK, GREEK_AS_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορ", "ABEZHIKMNOPTYXavop"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HIDDEN = r"[\x{AD}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{1D173}-\x{1D17A}\x{E0001}\x{E0020}-\x{E007F}]"
PICTURE = r"[\x{A9}\x{AE}\x{203C}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}]"
WIDE = "".join(chr(c) for r in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(*r))


def bound(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def consistent(x: str) -> str:
    """The consistent form of a text: joiners between pictures set aside, hidden characters deleted, characters exchanged, composed, and mixed words put into one script."""
    join = f"regexp_replace(@, '({PICTURE}[\\x{{FE0F}}\\x{{20E3}}\\x{{1F3FB}}-\\x{{1F3FF}}]*)\\x{{200D}}({PICTURE})', '\\1' || chr(61439) || '\\2', 'g')"
    shown = f"replace(regexp_replace({join.replace('@', join.replace('@', x))}, '{HIDDEN}', '', 'g'), chr(61439), chr(8205))"
    plain = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
    exchanged = f"nfc_normalize(translate({shown}, '{WIDE}{HALF_KANA[0]}{SPACES}', '{plain}{HALF_KANA[1]}{' ' * len(SPACES)}'))"
    has = lambda w, script, but="": f"len(list_filter(string_split({w}, ''), lambda c: regexp_matches(c, '\\p{{{script}}}') AND NOT contains('{but}', c))) > 0"
    number = lambda v, script: f"len(list_filter(string_split({v}, ''), lambda c: regexp_matches(c, '\\p{{{script}}}')))"
    latin = f"translate(w, '{CYRILLIC}{GREEK}', '{CYRILLIC_AS_LATIN}{GREEK_AS_LATIN}')"
    cyrillic, greek = f"translate(w, '{CYRILLIC_AS_LATIN}', '{CYRILLIC}')", f"translate(w, '{GREEK_AS_LATIN}', '{GREEK}')"
    word = f"""CASE WHEN NOT ({has('w', 'Latin')} AND ({has('w', 'Cyrillic')} OR {has('w', 'Greek')})) THEN w
      WHEN {has('w', 'Latin', CYRILLIC_AS_LATIN + GREEK_AS_LATIN)} THEN {latin} WHEN {has('w', 'Cyrillic', CYRILLIC)} THEN {cyrillic} WHEN {has('w', 'Greek', GREEK)} THEN {greek}
      WHEN {number('v', 'Cyrillic')} > {number('v', 'Latin')} THEN {cyrillic} WHEN {number('v', 'Greek')} > {number('v', 'Latin')} THEN {greek} ELSE {latin} END"""
    one = "[\\p{Latin}\\p{Cyrillic}\\p{Greek}\\p{M}]+|[^\\p{Latin}\\p{Cyrillic}\\p{Greek}\\p{M}]+"
    # Words are looked at only where a text holds letters of both sorts; the others are themselves.
    both = "regexp_matches(v, '\\p{Latin}') AND regexp_matches(v, '[\\p{Cyrillic}\\p{Greek}]')"
    return bound(exchanged, "v", f"CASE WHEN {both} THEN array_to_string(list_transform(regexp_extract_all(v, '{one}'), lambda w: {word}), '') ELSE v END")


def canonical_of(source: str, texts: list[str], keep: list[str]) -> str:
    return f"SELECT {', '.join(keep)}, {', '.join(f'{consistent(t)} AS {t}' for t in texts)} FROM ({source})"


def letters(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def folded(x: str) -> str:
    return f"regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


#: All pairs of rows with a piece in common, counted: brute force.
ALIKE = f"""form AS ({canonical_of("SELECT doc_id, coalesce(title, '') || ' ' || body AS t, body FROM search_index WHERE body IS NOT NULL", ["t", "body"], ["doc_id"])}),
  plain AS (SELECT doc_id, {letters('t')} AS s FROM form WHERE length({letters('body')}) >= 80),
  pieces AS (SELECT DISTINCT doc_id, substr(s, k, 4) AS g FROM (SELECT doc_id, s, unnest(range(1, length(s) - 2)) AS k FROM plain)),
  sizes AS (SELECT doc_id, count(*) AS n FROM pieces GROUP BY ALL),
  common AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM pieces a JOIN pieces b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  alike AS (SELECT doc_a, doc_b, c, x.n + y.n - c AS u FROM common JOIN sizes x ON doc_a = x.doc_id JOIN sizes y ON doc_b = y.doc_id WHERE c >= 0.6 * (x.n + y.n - c))"""

RUNS = "SELECT {id}, {chars} AS chars, array_to_string(w[k:k + 9], ' ') AS r FROM (SELECT *, unnest(range(1, len(w) - 8)) AS k FROM {words})"
LETTER_RUNS = "SELECT {id}, true AS chars, substr(s, k, 20) AS r FROM (SELECT *, unnest(range(1, length(s) - 18)) AS k FROM (SELECT *, array_to_string(w, '') AS s FROM {words}))"

ORACLES = {
    "p1_found": f"WITH {ALIKE} SELECT doc_a, doc_b FROM alike",
    "p1_groups": f"""WITH RECURSIVE {ALIKE},
  class AS (SELECT doc_id, least(doc_id, coalesce(min(doc_a), doc_id)) AS class_id FROM sizes LEFT JOIN (SELECT doc_a, doc_b FROM alike WHERE c = u) ON doc_b = doc_id GROUP BY doc_id),
  edge AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM (SELECT doc_a, doc_b FROM alike UNION ALL SELECT doc_b, doc_a FROM alike)
    JOIN class x ON doc_a = x.doc_id JOIN class y ON doc_b = y.doc_id WHERE x.class_id <> y.class_id),
  reach AS (SELECT class_id AS a, class_id AS b FROM class UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT doc_id, class_id, (SELECT count(*) FROM edge WHERE a = class_id) AS links, (SELECT min(b) FROM reach WHERE a = class_id) AS group_id FROM class""",
    "p2_found": f"""WITH {MARGINS}
SELECT doc_id, term FROM cells JOIN column_totals USING (term) WHERE tf >= 3 AND records BETWEEN 2 AND 5""",
    "p2_scores": f"""WITH {MARGINS}, e AS (
  SELECT doc_id, term, tf, records, r * c / n AS expected, (1 - r / n) * (1 - c / n) AS spread
  FROM cells JOIN row_totals USING (doc_id) JOIN column_totals USING (term) CROSS JOIN total)
SELECT doc_id, term, tf, records, round(expected, 4) AS expected, round((tf - expected) / sqrt(expected), 4) AS residual,
  round(CASE WHEN spread > 0 THEN (tf - expected) / sqrt(expected) / sqrt(spread) ELSE 0 END, 4) AS adjusted FROM e""",
    "p3_found": f"""WITH f AS (SELECT doc_id, 'title' AS field, title AS x FROM search_index UNION ALL SELECT doc_id, 'body', body FROM search_index)
SELECT doc_id, field FROM f
WHERE regexp_matches(x, '{DEVIATING}') OR contains(regexp_replace(x, '{JOINED_EMOJI}', '', 'g'), chr(8205)) OR nfc_normalize(x) <> x
  OR len(list_filter(regexp_extract_all(x, '[\\p{{L}}\\p{{M}}]+'), lambda w: regexp_matches(w, '[A-Za-zÀ-ɏ]') AND regexp_matches(w, '[Ͱ-Ͽἀ-῿Ѐ-ԯ]'))) > 0""",
    "p4_found": f"""WITH {TOKENS}, f AS (SELECT term, count(DISTINCT doc_id) AS records FROM tokens GROUP BY ALL)
SELECT term, CASE WHEN records = 1 THEN 'rare' ELSE 'common' END AS verdict FROM f WHERE records = 1 OR records * 20 > (SELECT count(*) FROM search_index)""",
    "p4_frequencies": f"""WITH {TOKENS}
SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS records,
  CASE WHEN count(DISTINCT doc_id) = 1 THEN 'rare' WHEN count(DISTINCT doc_id) * 20 > (SELECT count(*) FROM search_index) THEN 'common' ELSE 'useful' END AS verdict
FROM tokens GROUP BY term""",
    "p3_canonical": canonical_of("SELECT doc_id, title, body FROM search_index", ["title", "body"], ["doc_id"]),
    "p7_found": f"""WITH docs AS ({canonical_of("SELECT doc_id, text FROM documents WHERE text IS NOT NULL", ["text"], ["doc_id"])}),
  items AS ({canonical_of("SELECT item_id, lang, text FROM eval_items", ["text"], ["item_id", "lang"])}),
  dw AS (SELECT doc_id, {folded('text')} AS w FROM docs),
  spaced AS (SELECT item_id, {folded('text')} AS w FROM items WHERE coalesce(lang, '') NOT IN ('ja', 'zh')),
  unspaced AS (SELECT item_id, {folded('text')} AS w FROM items WHERE lang IN ('ja', 'zh')),
  held AS ({RUNS.format(id='doc_id', chars='false', words='dw')} UNION ALL {LETTER_RUNS.format(id='doc_id', words='dw')}),
  asked AS ({RUNS.format(id='item_id', chars='false', words='spaced')} UNION ALL {LETTER_RUNS.format(id='item_id', words='unspaced')})
SELECT DISTINCT doc_id, item_id FROM held JOIN asked USING (chars, r)""",
    "p5_plain": r"SELECT doc_id, body AS text FROM search_index WHERE NOT regexp_matches(body, '[<>&\\\[{|`$*_~''#=-]')",
    "p8_cover": rf"SELECT * FROM (SELECT doc_id, regexp_replace(text, '{WHITE}', '', 'g') AS text FROM documents) WHERE text <> ''",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
