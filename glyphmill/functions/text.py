"""Script-aware tokenization and token expansion as Column expressions.

Everything here is built from Spark's own functions, so it stays in the JVM. A null text gives a null list;
callers that explode it therefore drop the row without a special case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-point ranges of the script groups.
LATIN = r"a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{1E00}-\x{1EFF}"
HANGUL = r"\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{FFA0}-\x{FFDC}"
HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}"
HIRAGANA = r"\x{3040}-\x{309F}"
KATAKANA = r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{FF65}-\x{FF9F}"
NUMBER = r"0-9\x{FF10}-\x{FF19}"
MARK = r"\x{300}-\x{36F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}"

#: Groups by name, in the order in which the token pattern tries them.
GROUPS = {"latin": LATIN, "hangul": HANGUL, "han": HAN, "hiragana": HIRAGANA, "katakana": KATAKANA, "number": NUMBER}

#: One token: a character of a group, then characters of the same group or marks. RE2 and Java read it alike.
TOKEN_PATTERN = "|".join(f"[{body}][{body}{MARK}]*" for body in GROUPS.values())

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed value: the 19 initial consonants in the order of the syllable block.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
FIRST_SYLLABLE, LAST_SYLLABLE, SYLLABLES_PER_INITIAL = 0xAC00, 0xD7A3, 588

#: Edge n-grams are of 2 to 8 code points.
NGRAM_MIN, NGRAM_MAX = 2, 8


def ascii_lower(col: Column) -> Column:
    """Lower-case A to Z only; accented capitals stay as they are."""
    return F.translate(col, UPPER, LOWER)


def tokenize(col: Column) -> Column:
    """Tokens of a text in order, with repeats: runs of one script group and its marks, ASCII lower-cased."""
    return F.regexp_extract_all(ascii_lower(col), F.lit(TOKEN_PATTERN), F.lit(0))


def script_group(col: Column) -> Column:
    """Group of the first character of a token."""
    out = F.lit("delimiter")
    for name, body in reversed(GROUPS.items()):
        out = F.when(col.rlike(f"^[{body}]"), F.lit(name)).otherwise(out)
    return F.when(col.rlike(f"^[{MARK}]"), F.lit("mark")).otherwise(out)


def is_initials(col: Column) -> Column:
    """True if the token is made of the 19 initial consonants only."""
    return col.rlike(f"^[{INITIALS}]+$")


def initials(col: Column) -> Column:
    """Initial consonants of a token's Hangul syllables, in order; other characters give nothing."""
    syllables = F.regexp_replace(col, r"[^\x{AC00}-\x{D7A3}]", "")
    index = lambda c: F.floor((F.ascii(c) - FIRST_SYLLABLE) / SYLLABLES_PER_INITIAL).cast("int")
    letters = F.transform(F.filter(F.split(syllables, ""), lambda c: c != ""), lambda c: F.substring(F.lit(INITIALS), index(c) + 1, 1))
    return F.when(F.length(syllables) > 0, F.array_join(letters, "")).otherwise(F.lit(""))


def _heads(col: Column, low: int, high: Column) -> Column:
    """First low, low+1, ... high code points of a text; an empty list where high is less than low."""
    return F.when(high >= low, F.transform(F.sequence(F.lit(low), F.greatest(high, F.lit(low))), lambda k: F.substring(col, F.lit(1), k))).otherwise(
        F.array().cast("array<string>")
    )


def initials_prefixes(col: Column, low: int, max_len: int) -> Column:
    """Beginnings, of low to max_len letters, of the initials of a token."""
    letters = initials(col)
    return _heads(letters, max(low, 1), F.least(F.length(letters), F.lit(max_len)))


def edge_ngrams(col: Column) -> Column:
    """Beginnings of a token, from 2 code points to one less than its length and at most 8."""
    return _heads(col, NGRAM_MIN, F.least(F.lit(NGRAM_MAX), F.length(col) - 1))


def register_sql(spark) -> None:
    """Make tokenization and expansion callable from SQL as gm_tokenize, gm_initials and gm_edge_ngrams."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION gm_tokenize(x STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(translate(x, '{UPPER}', '{LOWER}'), r'{TOKEN_PATTERN}', 0)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION gm_initials(x STRING) RETURNS STRING RETURN array_join(transform("
        r"filter(split(regexp_replace(x, r'[^\x{AC00}-\x{D7A3}]', ''), ''), c -> c <> ''), "
        f"c -> substring('{INITIALS}', cast(floor((ascii(c) - {FIRST_SYLLABLE}) / {SYLLABLES_PER_INITIAL}) as int) + 1, 1)), '')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION gm_edge_ngrams(x STRING) RETURNS ARRAY<STRING> RETURN "
        f"CASE WHEN char_length(x) > {NGRAM_MIN} THEN transform(sequence({NGRAM_MIN}, least({NGRAM_MAX}, greatest({NGRAM_MIN}, char_length(x) - 1))), k -> substring(x, 1, k)) ELSE cast(array() as array<string>) END"
    )
