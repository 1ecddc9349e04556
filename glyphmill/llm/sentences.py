"""Sentence units of texts in many languages and scripts, in SQL expressions only.

Addresses (URLs, hosts, mail, file names) are masked as whole spans first; then full stops that end nothing (in decimals,
initials, abbreviations, dates, ellipses) and every terminator inside a quotation or bracket are masked by private-use
placeholders; the text is then split by terminator patterns of each script, and the placeholders are turned back. A text
that holds such characters itself is split with others in their place, and its units are cut out of the text as stored. Every step is a Spark function on the row, so nothing is shuffled and no
Python runs; whole texts are used.

The first line with content is a title and one unit; a blank line ends a unit; any other line break counts as a space.
A quotation or bracket ends a unit when it closes a whole sentence: in scripts with capitals if a capital or digit
follows, in others if a colon or comma introduced it and the sentence doesn't go on.

Defined results: null, empty and blank texts have no unit; rows repeated are split each by itself; an empty table gives
an empty result; columns not asked for are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.tables import let

# Abbreviations whose full stop ends no sentence, by language.
ABBREVIATIONS = {
    "en": "Dr Mr Mrs Ms Prof St Mt Rev Hon Gen Col Capt Lt Sgt Gov Sen Rep vs No Nos Fig fig Figs figs pp Vol vol vols approx ca est op cit cf ed eds al ver Ver Ph",
    "de": "Nr Abb Bd Kap Hl bzw vgl Vgl Hrsg Aufl Str inkl ggf evtl geb gest Dipl Ing",
    "fr": "cie Cie env cf vol av apr chap art Mme Mlle MM",
    "es": "Sr Sra Srta Dra Dña núm pág págs aprox ej Ud Uds cap Lic",
    "ru": "ок рис см См тыс млн млрд руб ул им стр гг др проф акад обл гор",
    "hi": "डॉ प्रो सं कि श्री",
    "th": "ดร พ ค",
}
#: Units of one letter, whose full stop behind a number may end a sentence.
UNITS = "mgtlhsмгтлкс"
MONTHS = "Jan Feb Mär Mrz Apr Jun Jul Aug Sep Sept Okt Nov Dez Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jh Jahrhundert Jahrhunderts Jahrhunderten"

# Short names of months whose full stop ends nothing before a number (without those that are other words too).
SHORT_MONTHS = "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mär Okt Dez janv févr avr juil déc ene abr ago dic янв фев апр июн июл авг сен окт ноя дек"

# Endings of file names, and characters of addresses.
FILE_ENDINGS = "html?|php|aspx?|pdf|js|css|txt|xml|json|csv|png|jpe?g|gif|svg|zip|docx?|xlsx?|exe"
_HOST = r"(?:[\p{IsLatin}\p{Nd}-]+\.)+[a-z]{2,}"
_IN_PATH = f"(?:[A-Za-z0-9_/%&=#~+:@,;$*-]|[.!?](?=[a-z0-9/%&=#_-])|\\?(?=[A-Za-z0-9_]+=)|\\.(?=(?i:{FILE_ENDINGS})(?![\\p{{L}}\\p{{N}}])))"
#: Spans that hold no end of a sentence; what follows a host or file name as a sentence does is left outside.
ADDRESS = (
    f"(?<![\\p{{IsLatin}}\\p{{Nd}}])(?:(?:https?|ftp)://(?:{_HOST}|localhost|[0-9.]+[0-9])(?::[0-9]+)?(?:[/?#]{_IN_PATH}*)?|www\\.{_HOST}(?:[/?#]{_IN_PATH}*)?"
    f"|[A-Za-z0-9._%+-]+@{_HOST}|[\\p{{IsLatin}}\\p{{Nd}}_-]+\\.(?i:{FILE_ENDINGS})(?![\\p{{L}}\\p{{N}}]))"
)

#: Placeholders for the straight quotation mark, opening and closing.
STRAIGHT = "\ue0d0\ue0d1"
#: Placeholder for a mark that opens in one language and closes here.
CLOSING = "\ue0d2"

# Pairs of quotation marks and brackets.
PAIRS = [("“", "”\ue0d2"), ("„", "“”\ue0d2"), ("«", "»"), ("「", "」"), ("『", "』"), ("《", "》"), ("（", "）"), ("(", ")"), ("[", "]"), ("【", "】"), (STRAIGHT[0], STRAIGHT[1])]
CLOSERS = "”»」』》）)】\\]’\ue0d1\ue0d2"
OPENERS = "“„«「『《（(\\[【‘\ue0d0"

TERMINATORS = ".!?…。！？．｡।॥؟۔"
MASKS = "".join(chr(0xE0A0 + i) for i in range(len(TERMINATORS)))
DOT = MASKS[0]
PARAGRAPH, END, PLAIN, INTRODUCED = "\ue0e0", "\ue0e1", "\ue0e2", "\ue0e3"
#: All placeholders, and the character that stands for them where a text holds them itself.
PLACEHOLDERS, OTHER = MASKS + STRAIGHT + CLOSING + PARAGRAPH + END + PLAIN + INTRODUCED, "\ue0f0"
#: White space other than line separators that are turned into line feeds first.
BLANK = " \t\r\n\x0b\f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SPACE = r" \t\r\n\x0B\f\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
_GAP, _NO_BREAK = f"[{SPACE}{PARAGRAPH}]", r"[ \t\r\x0B\f\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_EDGE = r"(?<![\p{L}\p{N}\p{M}])"
_OPEN = f"(?:«[{SPACE}]|[{OPENERS}¿¡])*"
_INTRO = f"(?:[:：,،，][{SPACE}]*)?"


def _any(words: str) -> str:
    return "|".join(sorted(dict.fromkeys(words.split()), key=len, reverse=True))


#: Alternatives behind which a full stop ends nothing, each read just behind the stop.
_NO_END = [
    f"(?<={_EDGE}(?:{_any(' '.join(ABBREVIATIONS.values()))})\\.)",
    f"(?<={_EDGE}\\p{{Ll}}\\.)(?<![ap]\\.m\\.)(?<!\\p{{Nd}}[{SPACE}][{UNITS}]\\.)",
    f"(?<={_EDGE}[\\p{{Lu}}\\p{{IsArabic}}]\\.)",
    r"(?<=\p{Nd}\.)(?=[\p{Nd}\p{Ll}])|(?<!\p{L}{3}\.)(?=\p{Nd})|(?<!\p{IsHangul}\.)(?=\p{Ll})",
    f"(?<=\\b\\p{{Nd}}{{1,2}}\\.)(?=[{SPACE}]+(?:{_any(MONTHS)})\\b)",
    f"(?=[{SPACE}]+\\p{{Nd}})(?<={_EDGE}(?:{_any(SHORT_MONTHS)})\\.)",
    f"(?<=\\p{{Nd}}\\.)(?=[{SPACE}]+\\p{{Nd}}{{1,2}}\\.)|(?<=\\p{{Nd}}\\.[{SPACE}]{{1,3}}\\p{{Nd}}{{1,2}}\\.)",
    r"(?<=\.\.)|(?=\.)",
]

#: Steps before quotations are looked at: (pattern, replacement), each one character for one but for END.
MASKING = [
    (r"[\r\x{85}\x{2028}\x{2029}](?!(?<=\r)\n)", "\n"),
    (f"\n(?={_NO_BREAK}*\n)", PARAGRAPH),
    (f'"(?<![^{SPACE}{PARAGRAPH}{OPENERS}—–-]")(?=\\S)', STRAIGHT[0]),
    (f"“(?<=[.!?…,\\p{{L}}\\p{{N}}]“)(?![\\p{{L}}\\p{{N}}¿¡])", CLOSING),
    (f"(?=[.…])((?:\\.{{2,}}|…+)[{CLOSERS}]*)(?=[{SPACE}]+{_OPEN}\\p{{Lu}})", f"$1{END}"),
    (f"\\.(?:{'|'.join(_NO_END)})", DOT),
    (r"．(?<=\p{Nd}．)(?=\p{Nd})", MASKS[TERMINATORS.index("．")]),
]

_NEXT = r"[\p{Lu}\p{Lt}\p{Lo}\p{Nd}\p{Sc}\p{So}¿¡§№]"
_CAPITAL = r"[\p{Lu}\p{Lt}\p{Nd}¿¡]"
#: Ends of units: terminators of scripts without capitals; ! and ? before what can begin a sentence; a full stop before a
#: space and such a beginning, or right before one if a word stands before it, or behind Hangul before any space.
_ENDS = [
    f"[。！？．｡।॥؟۔]+[!?]*[{CLOSERS}]*",
    f"[!?]+[{CLOSERS}]*(?=[{SPACE}]+{_OPEN}[^\\p{{Ll}}\\p{{P}}{SPACE}]|[{SPACE}]+[{OPENERS}¿¡]+|{_OPEN}[\\p{{Lu}}\\p{{Lo}}])",
    f"\\.[{CLOSERS}]*(?=[{SPACE}]+{_OPEN}{_NEXT})",
    f"\\.(?<=(?:[\\p{{L}}\\p{{M}}]{{2}}|[\\p{{Lo}}\\p{{M}}\\p{{Nd}}])\\.)[{CLOSERS}]*(?={_OPEN}[\\p{{Lu}}\\p{{Lo}}])",
    r"\.(?<=\p{L}{3}\.)(?=\p{Nd})",
    f"\\.(?<=\\p{{IsHangul}}[{CLOSERS}]?\\.)[{CLOSERS}]*(?=[{SPACE}]*\\p{{Ll}})",
]
#: Puts END behind each unit, after quotations have been masked.
SPLIT = (f"(?=[.!?。！？．｡।॥؟۔])({'|'.join(_ENDS)})", f"$1{END}")
#: Puts END behind a quotation or bracket that closes a sentence.
CLOSE = (f"{PLAIN}(?=[{SPACE}]+{_OPEN}{_CAPITAL})|{INTRODUCED}(?![{SPACE}]*(?:[\\p{{Ll}},;:.،，、；—–]|と|って|라|하고|고[{SPACE}]|{END}))", END)
#: In Thai a space with no digit beside it ends a unit.
THAI = (f"([\\p{{IsThai}}{CLOSERS}](?<!\\p{{Nd}}))(?=[{SPACE}]+{_OPEN}\\p{{IsThai}}(?<!\\p{{Nd}}))", f"$1{END}")


UNIT_LIST = "array<struct<end_pos:bigint,unit:string>>"
#: Pieces of a text that are added up at once.
PART = 200


def _apply(col: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def _mask_addresses(col: Column) -> Column:
    """Terminators inside addresses masked."""
    pieces = F.regexp_extract_all(col, F.lit(f"{ADDRESS}|[\\p{{IsLatin}}\\p{{Nd}}]+|[^\\p{{IsLatin}}\\p{{Nd}}]+"), F.lit(0))  # an address begins at a run of letters
    masked = F.transform(pieces, lambda piece: F.when(F.contains(piece, F.lit(".")) & piece.rlike(f"^{ADDRESS}$"), F.translate(piece, TERMINATORS, MASKS)).otherwise(piece))
    may_hold = F.contains(col, F.lit("://")) | F.contains(col, F.lit("www.")) | F.contains(col, F.lit("@")) | col.rlike(f"\\.(?i:{FILE_ENDINGS})(?![\\p{{L}}\\p{{N}}])")
    return F.when(may_hold, F.array_join(masked, "")).otherwise(col)


def _mask_quoted(col: Column) -> Column:
    """Terminators inside pairs masked; behind a pair whose last character before the closing mark is one, a note of whether it was introduced."""
    pairs = "|".join(f"{re.escape(o)}[^{re.escape(c)}{PARAGRAPH}]*[{re.escape(c)}]" for o, c in PAIRS)
    pieces = F.regexp_extract_all(col, F.lit(f"(?s){_INTRO}(?:{pairs})|[^{OPENERS}:：,،，]+|."), F.lit(0))

    def mask(piece: Column) -> Column:
        inner = F.translate(piece, TERMINATORS, MASKS)
        note = F.when(inner.rlike(f"[{MASKS}]{_GAP}?[{CLOSERS}]$"), F.when(piece.rlike(r"^[:：,،，]"), F.lit(INTRODUCED)).otherwise(F.lit(PLAIN))).otherwise(F.lit(""))
        return F.when((F.length(piece) > 2) & piece.rlike(f"(?s)^{_INTRO}[{OPENERS}].*[{CLOSERS}]$"), F.concat(inner, note)).otherwise(piece)

    return F.array_join(F.transform(pieces, mask), "")


def _marked(rest: Column) -> Column:
    """What follows the title, with END behind each unit."""
    def ended(masked: Column) -> Column:
        quoted = F.regexp_replace(F.regexp_replace(_mask_quoted(masked), *SPLIT), *CLOSE)
        return F.when(masked.rlike(f"[{OPENERS}]"), F.translate(quoted, PLAIN + INTRODUCED, "")).otherwise(F.regexp_replace(masked, *SPLIT))

    split = let(F.translate(_apply(let(rest, _mask_addresses), MASKING), '"', STRAIGHT[1]), ended)
    split = let(split, lambda x: F.when(x.rlike("[\u0e01-\u0e5b]"), F.regexp_replace(x, *THAI)).otherwise(x))
    return F.replace(split, F.lit(PARAGRAPH), F.lit(END + PARAGRAPH))


def _restore(col: Column) -> Column:
    return F.translate(col, MASKS + PARAGRAPH + STRAIGHT + CLOSING, TERMINATORS + '\n""“')


def _units(title: Column, rest: Column, stored: Column | None) -> Column:
    """array<struct<end_pos, unit>> of a title part and what follows it; units are null without the stored text."""
    pieces = F.concat(F.array(title), F.split(_marked(rest), END, -1))
    blank = F.lit(BLANK + PARAGRAPH)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(UNIT_LIST).alias("units"))

    def step(acc: Column, piece: Column) -> Column:
        kept = F.rtrim(piece, blank)
        text = F.lit(None).cast("string")
        if stored is not None:
            begin = F.length(kept) - F.length(F.ltrim(kept, blank))
            text = F.when(stored.rlike(f"[{PLACEHOLDERS}]"), F.substring(stored, acc["pos"] + begin + 1, F.length(kept) - begin)).otherwise(_restore(F.ltrim(kept, blank)))
        unit = F.struct((acc["pos"] + F.length(kept)).cast("bigint").alias("end_pos"), text.alias("unit"))
        units = F.when(F.length(kept) > 0, F.concat(acc["units"], F.array(unit))).otherwise(acc["units"])
        return F.struct((acc["pos"] + F.length(piece)).alias("pos"), units.alias("units"))

    def parts(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["pos"].alias("pos"), F.array().cast(UNIT_LIST).alias("units")), step)
        return let(inner, lambda i: F.struct(i["pos"].alias("pos"), F.concat(acc["units"], i["units"]).alias("units")))

    # In parts, as each step copies the list so far: a text of any length costs little more than its length.
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / PART).cast("int")), lambda i: F.slice(p, i * PART + 1, PART))
    return F.aggregate(let(pieces, cut), start, parts, lambda acc: acc["units"])


def sentence_units(df: DataFrame, id_col: str, text_col: str, with_text: bool = True) -> DataFrame:
    """id_col, unit_no (from 0), end_pos (code points from the start of the text through the unit's last character) and, if wanted, unit."""
    stored = F.col("stored")
    head = lambda text: F.regexp_extract(text, f"^[{SPACE}]*[^\r\n\\x{{85}}\\x{{2028}}\\x{{2029}}]*", 0)
    free = F.when(stored.rlike(f"[{PLACEHOLDERS}]"), F.translate(stored, PLACEHOLDERS, OTHER * len(PLACEHOLDERS))).otherwise(stored)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("stored")).where(stored.rlike(f"[^{SPACE}]"))
    split = let(free, lambda text: let(head(text), lambda h: _units(h, F.substring(text, F.length(h) + 1, F.length(text)), stored if with_text else None)))
    out = rows.select("id", F.posexplode(split).alias("unit_no", "u"))
    return out.select(F.col("id").alias(id_col), "unit_no", "u.end_pos", *["u.unit"] * with_text)
