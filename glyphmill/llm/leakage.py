"""Passages of held-out items inside a corpus.

Texts are brought to the consistent form, folded in case and reduced to units: words (runs of letters and digits), or single
letters and digits for items in scripts without spaces. Documents and items are cut into windows of the size of a passage,
one at every unit. Each window is embedded by the CGK random walk, which turns edit distance into Hamming distance;
positions of the embedding are sampled and hashed to a key, and that is repeated often enough to reach the target recall
for the edits allowed. Windows whose keys meet are verified by exact edit distance: the item's passage against the text
around the document's window. Equal windows have equal keys in every repetition, so runs without edits are never lost.

The keys of the items are made once. Up to BROADCAST_WINDOWS of them (and BROADCAST_CHARACTERS of item texts), both counted
before, they are sent to the workers as sorted arrays and the corpus is read where it lies, without a shuffle. Beyond that
the keys of both sides are joined by shuffle; a key that many documents hold is cut into SALTS shares, and the windows that
met are joined with the texts, written once, for the same verification. A text repeated any number of times makes no hot
group in the first way and is spread over the shares in the second.

Defined results: null, empty and short texts and items hold no passage; a row of the corpus gives one row for each item it
holds, also if its id is repeated; items with the same id count as one; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from glyphmill.llm.canon import canonical
from glyphmill.operators.tables import cut_lineage

UNSPACED = ("ja", "zh", "th", "lo", "km", "my")
#: Item keys, and letters of item texts, that are sent to every worker at most.
BROADCAST_WINDOWS, BROADCAST_CHARACTERS = 2_000_000, 20_000_000
#: Shares of a key in the join by shuffle.
SALTS = 16

# Parameters of the embedding, for windows of words and of single characters: steps of a walk, positions sampled from it by
# each repetition. A walk goes on by a character every other step on average.
STEPS, SAMPLED = {True: 64, False: 24}, {True: 12, False: 6}
#: Walks over which the repetitions are spread.
WALKS = 2
SEED = 20_117
#: Documents embedded at once.
TEXTS_AT_ONCE = 1_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Sketch:
    """Keys of windows: CGK walks, and bit sampling from them `repeats` times."""

    def __init__(self, words: bool, repeats: int) -> None:
        rng = np.random.default_rng(SEED + words)
        steps, sampled = STEPS[words], SAMPLED[words]
        number = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
        self.walks = [(number(steps), [r for r in range(repeats) if r % WALKS == w]) for w in range(min(WALKS, repeats))]
        self.places = [{int(p): number(1)[0] for p in rng.choice(steps, sampled, replace=False)} for _ in range(repeats)]

    def keys(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One row of keys for each repetition, one column for each window of the character codes."""
        out = np.zeros((len(self.places), len(starts)), np.uint64)
        out += np.arange(len(out), dtype=np.uint64)[:, None]  # repetitions don't meet each other
        codes = np.append(codes.astype(np.uint64) + np.uint64(1), np.uint64(0))
        past = len(codes) - 1  # the walk of a window that is over reads the padding symbol
        for bits, repeats in self.walks:
            at = starts.copy()
            last = max(max(self.places[r]) for r in repeats)
            for step in range(last + 1):
                symbol = codes[np.where(at < ends, at, past)]
                for r in repeats:
                    if (weight := self.places[r].get(step)) is not None:
                        row = out[r]
                        row ^= symbol * weight
                        row *= _MIX
                        row ^= row >> np.uint64(29)
                at += ((symbol * bits[step]) >> np.uint64(63)).astype(np.int64)
        return out


def repetitions(words: bool, max_edits: int, recall: float) -> int:
    """Repetitions that reach the recall if each edit changes about twice its number of the embedding's positions."""
    if max_edits == 0:
        return 1
    same = max(0.05, 1 - min(0.9, 2.0 * max_edits * (max_edits + 1) / STEPS[words])) ** SAMPLED[words]
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def edit_distance_inside(pattern: str, text: str) -> int:
    """Fewest edits that turn the pattern into some part of the text."""
    if pattern in text:
        return 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.zeros(len(codes) + 1, np.int64)
    places = np.arange(len(codes) + 1)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


def can_be_within(pattern: str, text: str, max_edits: int) -> bool:
    """A necessary condition for so few edits: of that many parts and one more, one stands in the text as it is."""
    ends = [len(pattern) * i // (max_edits + 1) for i in range(max_edits + 2)]
    return any(pattern[a:b] in text for a, b in zip(ends, ends[1:], strict=False))


class Windows:
    """Units of texts and the keys of their windows."""

    def __init__(self, run: dict[bool, int], max_edits: int, recall: float) -> None:
        import regex

        self.find = regex.compile(r"[\p{L}\p{N}]+").findall
        self.unspaced = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]").search
        self.run, self.max_edits = run, max_edits
        self.sketch = {words: Sketch(words, repetitions(words, max_edits, recall)) for words in (True, False)}

    def units(self, text: str | None, words: bool) -> list[str]:
        found = self.find((text or "").casefold())
        return found if words else list("".join(found))

    def keys(self, texts: list[list[str]], words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (repetitions by windows), number of the text and place in its units of every window."""
        run, gap = self.run[words], " " if words else ""
        joined, starts, ends, number, place, base = [], [], [], [], [], 0
        for i, units in enumerate(texts):
            n = len(units) - run + 1
            if n < 1:
                continue
            lengths = np.fromiter(map(len, units), np.int64, len(units))
            begin = base + np.cumsum(lengths + len(gap)) - lengths - len(gap)
            starts.append(begin[:n])
            ends.append((begin + lengths)[run - 1 :])
            number.append(np.full(n, i))
            place.append(np.arange(n))
            joined.append(gap.join(units) + gap)
            base += len(joined[-1])
        if not joined:
            return np.zeros((len(self.sketch[words].places), 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
        keys = self.sketch[words].keys(codes, np.concatenate(starts), np.concatenate(ends))
        keys = keys << np.uint64(1) | np.uint64(words)  # windows of words and of characters don't meet
        return keys, np.concatenate(number), np.concatenate(place)

    def edits(self, text: list[str], item: list[str], words: bool, pairs: list[tuple[int, int]]) -> int:
        """Fewest edits between a passage of the item and the text around a window that met it, or -1 if more than allowed."""
        run, gap = self.run[words], " " if words else ""
        best, spare = self.max_edits + 1, 2 if self.max_edits else 0
        for at, place in sorted(pairs):
            passage = gap.join(item[place : place + run])
            around = gap.join(text[max(0, at - spare) : at + run + spare])
            if can_be_within(passage, around, best - 1):
                best = min(best, edit_distance_inside(passage, around))
            if best == 0:
                return 0
        return best if best <= self.max_edits else -1


def _item_keys(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    """key, no, place of every window of items (no, words, text)."""
    for batch in batches:
        numbers, flags, texts = (c.to_pylist() for c in batch.columns)
        for words in (True, False):
            mine = [i for i, w in enumerate(flags) if w == words]
            keys, number, place = windows.keys([windows.units(texts[i], words) for i in mine], words)
            no = np.array([numbers[i] for i in mine], np.int64)[number] if mine else number
            for row in keys:
                yield pa.RecordBatch.from_arrays([pa.array(row.view(np.int64)), pa.array(no), pa.array(place)], ["key", "no", "place"])


class Held:
    """Item keys in order and the items they are of."""

    def __init__(self, windows: Windows, keys: np.ndarray, numbers: np.ndarray, places: np.ndarray, items: dict[int, tuple[bool, str]]) -> None:
        self.windows, self.keys, self.numbers, self.places = windows, keys, numbers, places
        self.words = {no: words for no, (words, _) in items.items()}
        self.units = {no: windows.units(text, words) for no, (words, text) in items.items()}
        # A text without a letter of such a script can hold a passage only if some passage has none either.
        self.every_text = any(not words and not all(map(windows.unspaced, self._runs(self.units[no]))) for no, words in self.words.items())

    def _runs(self, units: list[str]) -> Iterator[str]:
        joined, run = "".join(units), self.windows.run[False]
        return (joined[i : i + run] for i in range(len(units) - run + 1))

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(number of the text, number of the item, edits) for every item that a text holds a passage of."""
        for words in set(self.words.values()):
            asked = [t is not None and (words or self.every_text or bool(self.windows.unspaced(t))) for t in texts]
            units = [self.windows.units(t, words) if a else [] for t, a in zip(texts, asked, strict=True)]
            keys, number, place = self.windows.keys(units, words)
            met: dict[tuple[int, int], set] = defaultdict(set)
            for row in keys:
                first = np.searchsorted(self.keys, row.view(np.int64), "left")
                found = np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == row.view(np.int64))
                last = np.searchsorted(self.keys, row.view(np.int64)[found], "right")
                for w, a, b in zip(found.tolist(), first[found].tolist(), last.tolist(), strict=True):
                    for k in range(a, b):
                        met[int(number[w]), int(self.numbers[k])].add((int(place[w]), int(self.places[k])))
            for (i, no), pairs in met.items():
                if (edits := self.windows.edits(units[i], self.units[no], words, list(pairs))) >= 0:
                    yield i, no, edits


def leaked(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, item_lang: str, word_run: int = 10, char_run: int = 20, max_edits: int = 1, recall: float = 0.95) -> DataFrame:
    """doc_id, item_id and edits: every document that shares with an item a run of word_run words (char_run letters and digits for items in scripts without spaces), within max_edits edits.

    With edits 0 none is lost; those with edits are found with the target recall.
    """
    sc = documents.sparkSession.sparkContext
    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("edits", T.IntegerType())])
    arrow_item = to_arrow_type(schema[item_id].dataType)
    run = {True: word_run, False: char_run}
    spaced = ~F.coalesce(F.lower(F.substring(item_lang, 1, 2)).isin(*UNSPACED), F.lit(False))
    known = canonical(items.where(F.col(item_text).isNotNull()).dropDuplicates([item_id]), [item_text], [item_id, item_lang])
    known = cut_lineage(known.select(F.col(item_id).alias("item"), spaced.alias("words"), F.col(item_text).alias("text")).withColumn("no", F.monotonically_increasing_id()))
    keys = cut_lineage(known.select("no", "words", "text").mapInArrow(lambda batches: _item_keys(batches, Windows(run, max_edits, recall)), "key bigint, no bigint, place bigint"))
    corpus = canonical(documents.where(F.col(text).isNotNull()), [text], [doc_id]).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    found, letters = keys.count(), known.agg(F.sum(F.length("text"))).first()[0] or 0
    if found > BROADCAST_WINDOWS or letters > BROADCAST_CHARACTERS:
        out = _joined(cut_lineage(corpus.withColumn("row", F.monotonically_increasing_id())), known, keys, run, max_edits, recall)
        return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "edits")
    if not found:
        return documents.sparkSession.createDataFrame([], schema)
    table = keys.orderBy("key").toArrow()
    held = {r.no: (r.words, r.text) for r in known.collect()}  # both within the bounds counted above
    shared = sc.broadcast((*(table.column(c).to_numpy() for c in ("key", "no", "place")), held, {r.no: r.item for r in known.select("no", "item").collect()}))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *arrays, texts, names = shared.value
        lists = Held(Windows(run, max_edits, recall), *arrays, texts)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                hits = list(lists.search(part.column(1).to_pylist()))
                ids = part.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([names[h[1]] for h in hits], arrow_item), pa.array([h[2] for h in hits], pa.int32())], [doc_id, item_id, "edits"])

    return corpus.mapInArrow(search, schema)


def _joined(corpus: DataFrame, items: DataFrame, keys: DataFrame, run: dict[bool, int], max_edits: int, recall: float) -> DataFrame:
    """doc, item and edits by joining the keys of both sides: corpus (doc, text, row), items (item, words, text, no), keys (key, no, place)."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(run, max_edits, recall)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                rows, texts = part.column(0).to_numpy(), part.column(1).to_pylist()
                for words in (True, False):
                    found, number, place = windows.keys([windows.units(t, words) for t in texts], words)
                    for row in found:
                        yield pa.RecordBatch.from_arrays([pa.array(row.view(np.int64)), pa.array(rows[number]), pa.array(place)], ["key", "row", "at"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(run, max_edits, recall)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("text", "other", "words", "pairs"))
            edits = [windows.edits(windows.units(a, w), windows.units(b, w), w, [(p["at"], p["place"]) for p in pairs]) for a, b, w, pairs in zip(*columns, strict=True)]
            done = pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("item"), pa.array(edits, pa.int32())], ["doc", "item", "edits"])
            yield done.filter(pa.array([e >= 0 for e in edits], pa.bool_()))

    asked = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    windows = corpus.select("row", "text").mapInArrow(embed, "key bigint, row bigint, at bigint").withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS)))
    met = windows.join(asked.hint("merge"), ["key", "salt"]).groupBy("row", "no").agg(F.collect_set(F.struct("at", "place")).alias("pairs"))  # the windows of one text and one item
    pairs = met.join(corpus.hint("merge"), "row").join(items.select("no", "item", "words", F.col("text").alias("other")).hint("merge"), "no")
    types = {f.name: f.dataType for f in pairs.schema.fields}
    schema = T.StructType([T.StructField("doc", types["doc"]), T.StructField("item", types["item"]), T.StructField("edits", T.IntegerType())])
    return pairs.select("doc", "item", "text", "other", "words", "pairs").mapInArrow(verify, schema)
