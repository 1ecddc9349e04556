"""One consistent form for text that reads alike but is stored in different characters.

The work is done by embedded DuckDB SQL on each Arrow batch of a partition (`nfc_normalize`, `translate`, regular
expressions), so a partition streams through one in-process database and nothing is shuffled.

The form: invisible format characters are removed (a joiner inside an emoji sequence stays), every space separator
becomes U+0020, full-width Latin letters and digits and half-width kana become their ordinary forms, presentation forms
of letters (mathematical alphabets, Latin ligatures) become plain letters, the result is composed (NFC), and look-alike
letters in a word that mixes Latin with Cyrillic or Greek are brought to one script. Punctuation, quotes, dashes,
superscripts, fractions, trade marks, line breaks and tabs stay.

Defined results: a null text stays null and deviates from nothing; an empty text stays empty; repeated rows stay
repeated; an empty table gives an empty table; columns not asked for are left out, so clashing names cannot meet.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Unicode classes, written for RE2.
SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
INVISIBLE = r"\x{AD}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{1D173}-\x{1D17A}\x{E0001}\x{E0020}-\x{E007F}"
EMOJI = r"\x{A9}\x{AE}\x{203C}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}"
EMOJI_MARKS = r"\x{FE0F}\x{20E3}\x{1F3FB}-\x{1F3FF}"
WIDE = r"\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF66}-\x{FF9F}"

# Letters of Cyrillic and Greek that look like the Latin letter in the same place.
CYRILLIC_TWINS = ("аеорсухіѕјһԁԛԝАВЕКМНОРСТХУІЅЈԚԜ", "aeopcyxisjhdqwABEKMHOPCTXYISJQW")
GREEK_TWINS = ("οναρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovapABEZHIKMNOPTYX")

#: An emoji sequence with its joiners, kept whole, or a subdivision flag with its tags; else one invisible character.
_INVISIBLE_PATTERN = f"([{EMOJI}][{EMOJI_MARKS}]*(?:\\x{{200D}}[{EMOJI}][{EMOJI_MARKS}]*)+|\\x{{1F3F4}}[\\x{{E0020}}-\\x{{E007E}}]+\\x{{E007F}})|[{INVISIBLE}]"
_LETTERS = r"\p{Latin}\p{Cyrillic}\p{Greek}\p{M}"
_MIXED = r"\p{Latin}\p{M}*[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{M}*\p{Latin}"


@lru_cache
def substitutions() -> tuple[str, str]:
    """Characters and what replaces each, one code point for one, by rule from the Unicode database."""
    pairs = {}
    for cp in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF66, 0xFFA0), *range(0x1D400, 0x1D800)):
        plain = unicodedata.normalize("NFKC", chr(cp))
        if len(plain) == 1 and plain != chr(cp):
            pairs[chr(cp)] = plain
    pairs |= {chr(cp): " " for cp in range(0x110000) if unicodedata.category(chr(cp)) == "Zs" and cp != 0x20}
    return "".join(pairs), "".join(pairs.values())


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _visible(x: str) -> str:
    """x without invisible characters."""
    return f"CASE WHEN regexp_matches({x}, {_quote(f'[{INVISIBLE}]')}) THEN regexp_replace({x}, {_quote(_INVISIBLE_PATTERN)}, '\\1', 'g') ELSE {x} END"


def _composed(x: str) -> str:
    old, new = substitutions()
    spelled = f"translate({x}, {_quote(old)}, {_quote(new)})"
    for cp in range(0xFB00, 0xFB07):
        spelled = f"replace({spelled}, '{chr(cp)}', '{unicodedata.normalize('NFKC', chr(cp))}')"
    return f"nfc_normalize({spelled})"


def _one_script(x: str) -> str:
    """x with the look-alikes of each mixed word brought to the script that its unmistakable letters name, or else to the script of most letters of x."""
    cyrillic, greek = CYRILLIC_TWINS, GREEK_TWINS
    to_latin = f"translate(w, {_quote(cyrillic[0] + greek[0])}, {_quote(cyrillic[1] + greek[1])})"
    to_cyrillic = f"translate(w, {_quote(cyrillic[1])}, {_quote(cyrillic[0])})"
    to_greek = f"translate(w, {_quote(greek[1])}, {_quote(greek[0])})"
    sure_latin = f"regexp_matches(translate(w, {_quote(''.join(dict.fromkeys(cyrillic[1] + greek[1])))}, ''), '\\p{{Latin}}')"
    sure_cyrillic = f"regexp_matches(translate(w, {_quote(cyrillic[0])}, ''), '\\p{{Cyrillic}}')"
    sure_greek = f"regexp_matches(translate(w, {_quote(greek[0])}, ''), '\\p{{Greek}}')"
    share = lambda script: f"length(regexp_replace({x}, '[^\\p{{{script}}}]+', '', 'g'))"
    word = (
        f"CASE WHEN NOT regexp_matches(w, {_quote(_MIXED)}) THEN w "
        f"WHEN {sure_latin} THEN {to_latin} WHEN {sure_cyrillic} THEN {to_cyrillic} WHEN {sure_greek} THEN {to_greek} "
        f"WHEN {share('Cyrillic')} > {share('Latin')} THEN {to_cyrillic} WHEN {share('Greek')} > {share('Latin')} THEN {to_greek} ELSE {to_latin} END"
    )
    pieces = f"regexp_extract_all({x}, '[{_LETTERS}]+|[^{_LETTERS}]+')"
    return f"CASE WHEN regexp_matches({x}, {_quote(_MIXED)}) THEN array_to_string(list_transform({pieces}, lambda w: {word}), '') ELSE {x} END"


def canonical_sql(texts: list[str], keep: list[str], flags: bool) -> str:
    """DuckDB SQL over a view `batch`: the kept columns, each text in its consistent form and, if asked, <text>_deviates."""
    q = lambda c: '"' + c.replace('"', '""') + '"'
    n = range(len(texts))
    first = ", ".join(f"{_visible(q(c))} AS v{i}, {q(c)} AS x{i}" for i, c in enumerate(texts))
    kept = ", ".join(f"{q(c)} AS k{i}" for i, c in enumerate(keep))
    carry = ", ".join(f"k{i}" for i in range(len(keep)))
    second = ", ".join(f"{_composed(f'v{i}')} AS c{i}, x{i}, v{i}" for i in n)
    out = [f"k{i} AS {q(c)}" for i, c in enumerate(keep)] + [f"{_one_script(f'c{i}')} AS {q(c)}" for i, c in enumerate(texts)]
    if flags:
        deviates = f"regexp_matches(x@, '[{WIDE}{SPACES}]') OR v@ <> x@ OR nfc_normalize(x@) <> x@ OR regexp_matches(x@, {_quote(_MIXED)})"
        out += [f"coalesce({deviates.replace('@', str(i))}, false) AS {q(c + '_deviates')}" for i, c in enumerate(texts)]
    sep = ", " if keep else ""
    return f"SELECT {', '.join(out)} FROM (SELECT {carry}{sep}{second} FROM (SELECT {kept}{sep}{first} FROM batch))"


def canonical(df: DataFrame, texts: list[str], keep: list[str], flags: bool = False) -> DataFrame:
    """The `keep` columns as they are and the `texts` columns in their consistent form.

    With `flags`, a boolean <text>_deviates says whether the stored text held a full-width letter or digit, a half-width
    kana, something canonical composition changes, an invisible character, an unusual space or a mixed-script word.
    """
    types = {f.name: f.dataType for f in df.select(*keep).schema.fields}
    fields = [T.StructField(c, types[c]) for c in keep] + [T.StructField(c, T.StringType()) for c in texts]
    fields += [T.StructField(f"{c}_deviates", T.BooleanType()) for c in texts] * flags
    sql = canonical_sql(texts, keep, flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        for batch in batches:
            if batch.num_rows:
                con.register("batch", pa.Table.from_batches([batch]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("batch")

    return df.select(*keep, *texts).mapInArrow(run, T.StructType(fields))
