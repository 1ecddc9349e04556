import re

import pytest

from glyphmill.llm.sentences import sentence_units

CASES = [
    ("en", "Title. With Dots?\nDr. Hill met J. K. Owmor at 3.30 a.m. sharp. The mill closes at 12 p.m. Is it open?! Yes.", ["Title. With Dots?", "Dr. Hill met J. K. Owmor at 3.30 a.m. sharp.", "The mill closes at 12 p.m.", "Is it open?!", "Yes."]),
    ("en", "T\nSee www.site.example, version 7.12.9.The end came.It fell 3.5 m. Now 12 left", ["T", "See www.site.example, version 7.12.9.", "The end came.", "It fell 3.5 m.", "Now 12 left"]),
    ("en", 'T\n"Keep it shut!" cried Vel, and left. Vel asked, "Who paid?" No one. Its motto, "Work. Wait. Win.", hangs here. (See fig. 8 for it.) Done.', ["T", '"Keep it shut!" cried Vel, and left.', 'Vel asked, "Who paid?"', "No one.", 'Its motto, "Work. Wait. Win.", hangs here.', "(See fig. 8 for it.)", "Done."]),
    ("en", "T\nIt breaks off... and goes on. The atlas says Mel… but not here. “It was old.” The rest is new.", ["T", "It breaks off... and goes on.", "The atlas says Mel… but not here.", "“It was old.”", "The rest is new."]),
    ("en", "T\nhttps://a.example/Search?Query=1 and www.Example.com/Page.Html for it. Node.Js reads Report.Txt! Write to A.B@site.example. Jan. 5 was cold. It is on www.site.example.The end. See ftp://x.example/a.b?c=D.E", ["T", "https://a.example/Search?Query=1 and www.Example.com/Page.Html for it.", "Node.Js reads Report.Txt!", "Write to A.B@site.example.", "Jan. 5 was cold.", "It is on www.site.example.", "The end.", "See ftp://x.example/a.b?c=D.E"]),
    ("en", "T \ue0a0\nA \ue0e1 mark and \ue0a0 stay. So does \ue0e0. Yes\ue0e2", ["T \ue0a0", "A \ue0e1 mark and \ue0a0 stay.", "So does \ue0e0.", "Yes\ue0e2"]),
    ("de", "T\nAm 5. Jan. 1903 kam sie. Am 6. Sept. ging sie. Siehe www.vel.example. Danach nichts.", ["T", "Am 5. Jan. 1903 kam sie.", "Am 6. Sept. ging sie.", "Siehe www.vel.example.", "Danach nichts."]),
    ("ja", "T\nhttps://a.example/xを見る。次はhttps://b.example/y.html。終", ["T", "https://a.example/xを見る。", "次はhttps://b.example/y.html。", "終"]),
    ("en", "T\n\nHeading\n\nOne line\nwrapped here. Two.\n \nThree", ["T", "Heading", "One line\nwrapped here.", "Two.", "Three"]),
    ("en", " \n\n  Late title \r\nText one.\r\n\r\nText two.\r\n", ["Late title", "Text one.", "Text two."]),
    ("de", "T\nAm 6. Juni 1703 kam Dr. Wen z. B. nach Prag. Auf dem Schild steht: „Bitte schließen.“ Sie wog ca. 1,3 kg. „Schließt die Höhle!“, rief Vel.", ["T", "Am 6. Juni 1703 kam Dr. Wen z. B. nach Prag.", "Auf dem Schild steht: „Bitte schließen.“", "Sie wog ca. 1,3 kg.", "„Schließt die Höhle!“, rief Vel."]),
    ("fr", "T\n« Qui a payé ? » cria Vel. La couche mesure 64,8 m. Quelle belle gare ! Voir p. 9, fig. 8.", ["T", "« Qui a payé ? » cria Vel.", "La couche mesure 64,8 m.", "Quelle belle gare !", "Voir p. 9, fig. 8."]),
    ("es", "T\nHacia 1779 a. C. ya existía. El Sr. Gar vio la pieza núm. 8 (pág. 6). «¿Quién pagó?», preguntó Ith. ¡Qué hermosa!", ["T", "Hacia 1779 a. C. ya existía.", "El Sr. Gar vio la pieza núm. 8 (pág. 6).", "«¿Quién pagó?», preguntó Ith.", "¡Qué hermosa!"]),
    ("ru", "T\nДлина ок. 90,19 км, см. рис. 3. А. Б. Пел нашёл 29 тыс. листов. «Закройте ворота!» — крикнул Оск. Слой 47,8 м. Был.", ["T", "Длина ок. 90,19 км, см. рис. 3.", "А. Б. Пел нашёл 29 тыс. листов.", "«Закройте ворота!» — крикнул Оск.", "Слой 47,8 м.", "Был."]),
    ("ko", 'T\n그는 왔다. ver. 9.4판은 좋다. "닫아라!"라는 말이 있다. "어디 있나?" 하고 물었다. 주소는 1869. 11. 10. 자로 바뀌었다. 여기서… 끊겼다.이 탑이다!', ["T", "그는 왔다.", "ver. 9.4판은 좋다.", '"닫아라!"라는 말이 있다.', '"어디 있나?" 하고 물었다.', "주소는 1869. 11. 10. 자로 바뀌었다.", "여기서… 끊겼다.", "이 탑이다!"]),
    ("ja", "T\n駅（旧・テトカ駅。現在は廃止）は開業した。記録は……途切れた。「閉めろ！」という声が残る。高さは3.5メートルだ。なんと見事だろう！次", ["T", "駅（旧・テトカ駅。現在は廃止）は開業した。", "記録は……途切れた。", "「閉めろ！」という声が残る。", "高さは3.5メートルだ。", "なんと見事だろう！", "次"]),
    ("zh", "T\n松溪问：“谁来付钱？”石林从和岛来。“快关上！”岛宁喊道。杂志《西宫！》报道了。完工了吗？是．好", ["T", "松溪问：“谁来付钱？”", "石林从和岛来。", "“快关上！”岛宁喊道。", "杂志《西宫！》报道了。", "完工了吗？", "是．", "好"]),
    ("hi", 'T\nडॉ. कासो ने 73.0 किमी मापा। "बंद करो!" जारि ने कहा। क्या यह बना? हाँ।', ["T", "डॉ. कासो ने 73.0 किमी मापा।", '"बंद करो!" जारि ने कहा।', "क्या यह बना?", "हाँ।"]),
    ("ar", "T\nقاس د. تاسور نحو 17.0 كم من الجدار. قال هار: «لم ينته العمل بعد.» هل اكتمل؟ نعم.", ["T", "قاس د. تاسور نحو 17.0 كم من الجدار.", "قال هار: «لم ينته العمل بعد.»", "هل اكتمل؟", "نعم."]),
    ("th", "ชื่อ เรื่อง\nมีผู้คน 228 คน อาศัยอยู่ ทำไมจึงหายไป? วัดได้ 24.34 เมตร", ["ชื่อ เรื่อง", "มีผู้คน 228 คน", "อาศัยอยู่", "ทำไมจึงหายไป?", "วัดได้ 24.34 เมตร"]),
]


@pytest.fixture(scope="module")
def units(spark):
    rows = sentence_units(spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "doc_id int, text string"), "doc_id", "text").collect()
    return {i: sorted((r for r in rows if r.doc_id == i), key=lambda r: r.unit_no) for i in range(len(CASES))}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{c[0]}{i}" for i, c in enumerate(CASES)])
def test_examples(units, i):
    assert [r.unit.replace("\r", "") for r in units[i]] == CASES[i][2]
    for r in units[i]:
        assert CASES[i][1][: r.end_pos].endswith(r.unit)


def test_dirty_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t　"), (4, "A"), (4, "A"), (None, "𠀀 b. C"), (6, "Start\n" + "One two three. " * 3_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, unit string, end_pos int")
    got = sentence_units(df, "doc_id", "text").collect()
    assert sorted((r.doc_id, r.end_pos) for r in got if r.doc_id in (1, 2, 3, 4)) == [(4, 1), (4, 1)]
    assert [r.end_pos for r in got if r.doc_id is None] == [6]
    ends = sorted(r.end_pos for r in got if r.doc_id == 6)
    assert len(ends) == 3_001 and ends[:3] == [5, 20, 35] and ends[-1] == 5 + 15 * 3_000
    assert sentence_units(df.limit(0), "doc_id", "text").collect() == []


def test_without_text(spark):
    df = spark.createDataFrame([(1, "A\nBe. Co")], "doc_id int, text string")
    assert [tuple(r) for r in sentence_units(df, "doc_id", "text", with_text=False).collect()] == [(1, 0, 1), (1, 1, 5), (1, 2, 8)]


def test_units_cover_the_text(spark, data):
    """All that stands between two units is white space, and units read as in the text."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.text and r.text.strip()}
    rows = sentence_units(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text").collect()
    assert {r.doc_id for r in rows} == set(docs)
    for i, text in docs.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.unit_no):
            assert re.sub(r"\s", "", text[at : r.end_pos]) == re.sub(r"\s", "", r.unit)
            at = r.end_pos
        assert not text[at:].strip()


def test_plan(spark):
    plan = sentence_units(spark.createDataFrame([(1, "a")], "doc_id int, text string"), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
