import random

import pytest

from glyphmill.llm import leakage

DOCS, ITEMS = "doc_id bigint, text string, item_id string", "item_id bigint, lang string, text string"
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
HAN = [chr(0x4E00 + 7 * i) for i in range(900)]


def search(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "z") for x in docs], DOCS)
    got = leakage.leaked(d, "doc_id", "text", spark.createDataFrame(items, ITEMS), "item_id", "text", "lang", **kw)
    return {(r.doc_id, r.item_id): r.edits for r in got.collect()}


def planted(seed=5):
    rng = random.Random(seed)
    items, docs, expected = [], [], set()
    for i in range(30):
        text = " ".join(rng.choices(WORDS, k=rng.randint(8, 30))) if i % 3 else "".join(rng.choices(HAN, k=rng.randint(15, 60)))
        items.append((i, "en" if i % 3 else "ja", text))
    for d in range(80):
        i, lang, text = rng.choice(items)
        units = text.split() if lang == "en" else list(text)
        run = rng.randint(7, 13) if lang == "en" else rng.randint(16, 24)
        start = rng.randint(0, max(0, len(units) - run))
        part = units[start : start + run]
        noise = lambda: rng.choices(WORDS if lang == "en" else HAN, k=rng.randint(0, 9))  # noqa: B023, E731
        sep = rng.choice([" ", ",  ", "\n"]) if lang == "en" else rng.choice(["", "、", " \n"])
        doc = noise() + part + noise()
        docs.append((d, sep.join(doc) if rng.random() < 0.5 else sep.join(doc).upper()))
    for d, t in docs:
        for i, lang, text in items:
            find = (lambda s: ["".join(c if c.isalnum() else " " for c in s.lower()).split()][0]) if lang == "en" else (lambda s: [c for c in s.lower() if c.isalnum()])
            a, b, n = find(t), find(text), 10 if lang == "en" else 20
            runs = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            if any(tuple(a[k : k + n]) in runs for k in range(len(a) - n + 1)):
                expected.add((d, i))
    return docs, items, expected


def test_equals_brute_force(spark):
    docs, items, expected = planted()
    for max_edits in (0, 1):
        assert {k for k, e in search(spark, docs, items, max_edits=max_edits).items() if e == 0} == expected and len(expected) > 20


@pytest.mark.parametrize("max_edits", [0, 1])
def test_join_of_keys_is_the_same(spark, monkeypatch, max_edits):
    docs, items, expected = planted(6)
    docs += docs[:2] + [(200, None), (201, "")]
    sent = search(spark, docs, items, max_edits=max_edits)
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 0)
    assert search(spark, docs, items, max_edits=max_edits) == sent and {k for k, e in sent.items() if e == 0} == expected


def test_consistent_form_and_edits(spark):
    text = "neither velmark nor sorith could explain why the veldane bell at drumor rang on that night"
    items = [(1, "en", text), (2, "en", "too short to count"), (3, None, None), (4, "en", "")]
    wide = text.replace("explain", "ｅｘｐｌａｉｎ").replace("bell", "b​ell").replace(" ", " ").replace("a", "а", 3)
    docs = [(1, wide), (2, "Intro: " + text.upper().replace(" ", ", ") + "!"), (3, text.replace("why", "wy")), (4, None), (5, ""), (6, " ".join(text.split()[:9])), (7, "x " * 60_000 + text)]
    assert search(spark, docs, items, max_edits=0) == {(1, 1): 0, (2, 1): 0, (7, 1): 0}
    near = search(spark, docs, items, max_edits=1, recall=0.999)
    assert {k: near[k] for k in ((1, 1), (2, 1), (7, 1))} == {(1, 1): 0, (2, 1): 0, (7, 1): 0} and near[(3, 1)] == 1


def test_recall_with_edits(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(WORDS, k=14)) for _ in range(150)]
    docs = []
    for i, t in enumerate(texts):
        at = rng.randrange(len(t))
        docs.append((i, t[:at] + rng.choice(["", "q", "qq"[:1] + t[at]]) + t[at + 1 :]))
    got = search(spark, docs, [(i, "en", t) for i, t in enumerate(texts)], max_edits=1, recall=0.95)
    assert sum((i, i) in got for i in range(150)) >= 0.9 * 150


def test_empty_tables_and_repeats(spark):
    item = [(1, "en", " ".join(WORDS[:12]))]
    assert search(spark, [], item) == {} and search(spark, [(1, " ".join(WORDS[:12]))], []) == {}
    d = spark.createDataFrame([(1, " ".join(WORDS[:12]), "z")] * 2, DOCS)
    assert leakage.leaked(d, "doc_id", "text", spark.createDataFrame(item * 2, ITEMS), "item_id", "text", "lang").count() == 2


@pytest.mark.parametrize("a, b, n", [("kitten", "xxsittingxx", 2), ("abc", "abc", 0), ("abc", "", 3), ("abcd", "abd", 1)])
def test_edit_distance(a, b, n):
    assert leakage.edit_distance_inside(a, b) == n


@pytest.mark.parametrize("words", [True, False])
def test_recall_over_languages(words):
    """One and two edits anywhere in a passage: keys meet in some repetition as often as asked for."""
    rng = random.Random(3)
    for edits in (1, 2):
        windows = leakage.Windows({True: 10, False: 20}, edits, 0.95)
        texts = [rng.choices(WORDS, k=10) if words else rng.choices(HAN, k=20) for _ in range(300)]
        changed = []
        for units in texts:
            units = list(units)
            for _ in range(edits):
                i = rng.randrange(len(units))
                at = rng.randrange(len(units[i]))
                units[i] = units[i][:at] + rng.choice("qx" if words else HAN) + units[i][at + 1 :]
            changed.append(units)
        a, b = windows.keys(texts, words)[0], windows.keys(changed, words)[0]
        assert (a == b).any(axis=0).mean() >= 0.9


def test_embedding_keeps_equal_windows_together():
    windows = leakage.Windows({True: 4, False: 20}, 1, 0.95)
    texts = [t.split() for t in ("same words in here", "other words in here", "same words in here and", "short")]
    keys, number, place = windows.keys(texts, True)
    assert number.tolist() == [0, 1, 2, 2] and place.tolist() == [0, 0, 0, 1]
    assert (keys[:, 0] == keys[:, 2]).all() and len(set(keys[0].tolist())) == 3 and len(set(keys[:, 0].tolist())) == len(keys)
