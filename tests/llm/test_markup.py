import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm.markup import clean_bodies, convert

PLAIN = [
    "The ratio stays < 27.5 and > 0 over 371 km².", "Cost $5 to $9 at stall #4, R&D at Vel & Co. included.", "Set A = (8, 7) has x^2 entries_8 and 3 * 6 tiles.",
    r"use \n in C and \t, too", "Price $5_a and $6_b$", r"The file C:\plans\velmark on the server, maps_old_4.txt.", "Its label (sic) reads Lun ~ 11 (a|b) [see below].", "* one\n* two\n1. three\n- four", "it's “quoted” – ½ ™", "# 4 is a number", "a -- b --- c", "", "  ", "C# and F#", "f[i](j k)", "== ", "1 < 2 && 3 > 2",
]
KINDS = [
    ('<p class="t">One two.</p>', "html"), ("Text<BR />more", "html"), ("Ends here.</P", "html"), ('Ends<a href="/wiki/x', "html"), ("A<!-- cached x --> b", "html"), ("Dot&#46; and&nbsp;space", "html"), ("&lt;p&gt;Escaped&lt;/p&gt;", "html"), ("R&amp;D", "html"),
    ("# Head\n\ntext", "markdown"), ("Head\n=====\n\ntext", "markdown"), ("a **strong** word", "markdown"), ("see [this](/wiki/x) now", "markdown"), ("![alt](img/x.png)", "markdown"), ("> quoted text", "markdown"), ("```\ncode\n```", "markdown"), ("| a | n |\n|---|---|\n| b | 3 |", "markdown"),
    ("a [[Target|word]] here", "wiki"), ("x {{stub}}", "wiki"), ("a '''bold''' word", "wiki"), ("== Head ==\ntext", "wiki"), ('{| class="w"\n! A\n|-\n| 3 || 4\n|}', "wiki"), ("{{Infobox place\n| name = X\n}}\ntext", "wiki"),
    ("\\section{Head}\ntext", "latex"), ("an \\emph{old} word", "latex"), ("\\begin{equation}\nx\n\\end{equation} % checked", "latex"), ("so $\\alpha + \\beta_{k}$ holds", "latex"), ("\\[ \\frac{a}{b} \\]", "latex"), ("{\\displaystyle \\sqrt{a^{2}}}", "latex"), ("see~\\cite{x}", "latex"),
]


@pytest.mark.parametrize("body", PLAIN)
def test_plain_bodies_stay(body):
    assert convert(body) == (body, [])


@pytest.mark.parametrize("body, kind", KINDS)
def test_kinds(body, kind):
    assert convert(body)[1] == [kind]


def test_several_kinds():
    assert convert("# H\n\nA [[b]] and <b>c</b> with \\emph{d}.")[1] == ["html", "latex", "markdown", "wiki"]
    assert convert("<math>\\sum_{i=1}^{n} x_i</math>")[1] == ["html", "latex"]


def clean(body):
    return convert(body)[0]


def test_html():
    body = '<h2 id="a">Geo</h2><p>The <b>old</b> mill &amp; dam stands, it is said, near Vel.</p><ul><li>One.</li><li>Two.</li></ul><pre><code>def f(x):\n    return x * 2</code></pre><table><tr><td>a</td><td>b</td></tr></table>'
    assert clean(body) == "## Geo\n\nThe old mill & dam stands, it is said, near Vel.\n\n- One.\n- Two.\n\n```\ndef f(x):\n    return x * 2\n```\n\na | b"


def test_markdown():
    body = "Title\n=====\n\nThe **old** [mill](/wiki/x) stands, it is said, near Vel.\n\n## Part\n\n- one\n- two\n\n```\nx = 1\n```"
    assert clean(body) == "# Title\n\nThe old mill stands, it is said, near Vel.\n\n## Part\n\n- one\n- two\n\n```\nx = 1\n```"


def test_wiki():
    body = "{{Infobox place\n| name = Vel\n| code = Q\n}}\nThe '''old''' [[Mill|mill]] of Vel stands, it is said, near the river.{{citation needed|date=X}}\n== Part ==\nIt fell, then rose.\n[[Category:Mills]]"
    assert clean(body) == "The old mill of Vel stands, it is said, near the river.\n\n## Part\n\nIt fell, then rose."


def test_latex():
    body = "\\section{Head}\nThe \\emph{old} mill stands, it is said, near Vel.\n\\begin{itemize}\n\\item One.\n\\item Two.\n\\end{itemize}\n\\begin{equation}\n\\frac{m v^{2}}{2}\n\\end{equation} % checked\n\\begin{verbatim}\nfor k in x:\n    print(k)\n\\end{verbatim}~\\cite{vel}"
    assert clean(body) == "## Head\n\nThe old mill stands, it is said, near Vel.\n\n- One.\n- Two.\n\n$$\\frac{m v^{2}}{2}$$\n\n```\nfor k in x:\n    print(k)\n```"


def test_cut_off():
    assert clean("<p>The mill stands.</P") == "The mill stands."
    assert clean("{{Infobox place\n| name = The mill stands, and stands") == "The mill stands, and stands"
    assert convert("```\nx = 1")[1] == ["markdown"]


LONG = "<div>" + "The long paragraph of the page goes on, and on, for a while. " * 12 + "</div>"


@pytest.mark.parametrize(
    "body, kept, gone",
    [
        (LONG + "<p>Population 4,210 (2019)</p>", "Population 4,210 (2019)", ""),
        (LONG + "<dl><dt>Height</dt><dd>33 m</dd></dl>", "Height\n\n33 m", ""),
        ("Intro line without stop\n\n" + LONG, "Intro line without stop", ""),
        (LONG + "<div>한국어 문장이 여기에 있다</div>", "한국어 문장이 여기에 있다", ""),
        (LONG + "<nav>Home. About.</nav>", "long paragraph", "Home"),
        (LONG + "<footer><p>Imprint, terms.</p></footer>", "long paragraph", "Imprint"),
        (LONG + '<div class="m"><span><a href="/">Home</a> | <a href="/a">About</a></span></div><p>End</p>', "End", "goes on </div>"),
        ("<section><p>" + LONG + '</p></section><aside><a href="/">Home</a> | <a href="/a">About us</a></aside>', "long paragraph", "About us"),
        ("<p>Only a <a href='/'>link</a></p>", "Only a link", ""),
        ("[one link](/x)", "one link", ""),
        (LONG + "<script>var a = 'Sentence. One.';</script>", "long", "Sentence"),
    ],
)
def test_paths_decide(body, kept, gone):
    assert kept in clean(body) and (not gone or gone not in clean(body))


def test_lists_keep_numbers_and_depth():
    assert clean("**a**\n\n1. one\n2. two\n   - inner\n10) ten") == "a\n\n1. one\n2. two\n  - inner\n10) ten"
    assert clean("<ol><li>one<ul><li>a</li><li>b</li></ul></li><li><p>two</p><p>more</p></li></ol>") == "1. one\n  - a\n  - b\n2. two\n  more"
    assert clean("[[X]]\n* one\n** two\n* three") == "X\n\n- one\n  - two\n- three"
    assert clean("\\begin{enumerate}\n\\item A\n\\begin{itemize}\\item B\\end{itemize}\n\\item C\n\\end{enumerate}") == "1. A\n  - B\n2. C"


def test_code_keeps_its_language():
    assert clean("```python\nx = 1\n```") == "```python\nx = 1\n```"
    assert clean('<pre><code class="language-c">int a;</code></pre>') == "```c\nint a;\n```"
    assert clean('<syntaxhighlight lang="go">a</syntaxhighlight>') == "```go\na\n```"
    assert clean("\\begin{lstlisting}[language=Ada]\na\n\\end{lstlisting}") == "```Ada\na\n```"


def test_tables_keep_rows():
    assert clean("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>") == "a | b\nc | d"
    assert clean('{| class="w"\n! A !! B\n|-\n| style="x" | 3 || 4\n|}') == "A | B\n3 | 4"


@pytest.mark.parametrize("n", [45, 3_000])
def test_any_depth(n):
    assert clean("\\emph{" * n + "word" + "}" * n) == "word"
    assert clean("<div>" * n + "word" + "</div>" * n) == "word"
    assert clean("&" + "amp;" * n + "lt;b&" + "amp;" * n + "gt;word&" + "amp;" * n + "lt;/b&" + "amp;" * n + "gt;") == "word"
    assert convert("{{a|" * n + "word" + "}}" * n)[1] == ["wiki"]


# Labelled bodies: the same content in four notations, two layouts and eight languages, between residue.
CONTENT = {
    "en": ("Old mill", "The mill of Vel stands near the river, it is said.", "Population 4,210", ["One wheel", "Two stones"]),
    "de": ("Alte Mühle", "Die Mühle von Vel steht am Fluss, wie man sagt.", "Höhe 33 m", ["Ein Rad", "Zwei Steine"]),
    "fr": ("Vieux moulin", "Le moulin de Vel se dresse près du fleuve, dit-on.", "Altitude 120 m", ["Une roue", "Deux meules"]),
    "ru": ("Старая мельница", "Мельница Вела стоит у реки, как говорят.", "Высота 33 м", ["Одно колесо", "Два камня"]),
    "ko": ("오래된 방앗간", "벨의 방앗간은 강가에 서 있다고 한다", "인구 4210명", ["바퀴 하나", "돌 두 개"]),
    "ja": ("古い水車", "ベルの水車は川のそばにあると言われる。", "高さ 33 メートル", ["車輪一つ", "石二つ"]),
    "zh": ("老磨坊", "据说维尔的磨坊在河边。", "高度 33 米", ["一个轮子", "两块石头"]),
    "ar": ("الطاحونة القديمة", "تقف طاحونة فيل قرب النهر كما يقال.", "الارتفاع 33 م", ["عجلة واحدة", "حجران"]),
}


def written(notation, rich, title, sentence, fact, items):
    """A body with its residue, and the texts that are content."""
    code = "for k in x:\n    print(k)"
    if notation == "html":
        body = f"<nav><a href='/'>Start</a> <a href='/b'>Index</a></nav><h2>{title}</h2><div><p>{sentence}<ref>Source, p. 3</ref></p></div><p>{fact}</p><ul><li>{items[0]}</li><li><b>{items[1]}</b></li></ul>"
        body += f"<pre>{code}</pre><script>track('x');</script><footer>Imprint</footer>" if rich else ""
    elif notation == "markdown":
        body = f"## {title}\n\n{sentence}\n\n{fact}\n\n- {items[0]}\n- **{items[1]}**\n\n![picture](img/x.png)"
        body += f"\n\n```\n{code}\n```\n" if rich else ""
    elif notation == "wiki":
        body = f"{{{{Infobox place\n| name = Boxname\n| code = Boxcode\n}}}}\n== {title} ==\n{sentence}\n\n'''{fact}'''\n\n* {items[0]}\n* [[Page|{items[1]}]]\n[[Category:Stuff]]"
        body += f"\n<syntaxhighlight lang='x'>{code}</syntaxhighlight>\n<references/>" if rich else ""
    else:
        body = f"\\section{{{title}}}\n{sentence}~\\cite{{vel99}}\n\n\\textbf{{{fact}}}\n\n\\begin{{itemize}}\n\\item {items[0]}\n\\item \\emph{{{items[1]}}}\n\\end{{itemize}}"
        body += f"\n\\begin{{verbatim}}\n{code}\n\\end{{verbatim}}\\label{{l1}}" if rich else ""
    return body, " ".join([title, sentence, fact, *items] + [code] * rich)


def test_recall_and_precision_of_labelled_bodies():
    from collections import Counter

    right = wanted = got = n = 0
    for notation in ("html", "markdown", "wiki", "latex"):
        for texts in CONTENT.values():
            for rich in (False, True):
                body, text = written(notation, rich, *texts)
                found, kinds = convert(body)
                assert notation in kinds
                a, b = (Counter(re.findall(r"\w+", x)) for x in (found, text))
                assert sum((a & b).values()) >= 0.9 * sum(b.values()), (notation, found)
                right, wanted, got, n = right + sum((a & b).values()), wanted + sum(b.values()), got + sum(a.values()), n + 1
    assert n == 64 and right >= 0.98 * wanted and right >= 0.98 * got


def rows_of_links(words, n):
    """Residue on elements that hold content elsewhere: a trail, a row with a count, a menu of blocks."""
    first, second, third = words
    return [
        f"<section><a href='/'>{first}</a> » <a href='/b'>{second}</a> » {third[:2]}</section>",
        f"<section><p><a href='/l'>{first} {second}</a> ({n}) <a href='/s'>{third} {second}</a></p></section>",
        "<section>" + "".join(f"<div><a href='/{w}'>{w}</a></div>" for w in words) + "</section>",
    ]


WORDS = {
    "en": ["Startpage", "Overview", "Contact"], "de": ["Startseite", "Übersicht", "Kontakt"], "fr": ["Accueil", "Sommaire", "Contacter"], "ru": ["Главная", "Обзор", "Контакты"],
    "ko": ["처음으로", "전체보기", "연락하기"], "ja": ["ホームページ", "一覧表示", "お問い合わせ"], "zh": ["网站首页", "全部内容", "联系我们"], "ar": ["الرئيسية", "المحتويات", "اتصال"],
}


def test_ratios_tell_residue_on_elements_of_content():
    from collections import Counter

    right = wanted = got = 0
    for language, (title, sentence, fact, items) in CONTENT.items():
        for n, row in enumerate(rows_of_links(WORDS[language], 7)):
            for page in (sentence, sentence * 40):
                body = f"<h2>{title}</h2>{row * (n < 2)}<p>{page}</p>{row * (n == 2)}<div>{fact}</div><ul><li>{items[0]}</li><li>{items[1]}</li></ul>"
                found = convert(body)[0]
                a, b = (Counter(re.findall(r"\w+", x)) for x in (found, " ".join([title, page, fact, *items])))
                right, wanted, got = right + sum((a & b).values()), wanted + sum(b.values()), got + sum(a.values())
                assert not any(w in found for w in WORDS[language]), found
    assert right == wanted == got


@pytest.mark.parametrize(
    "text",
    [
        "<a href='/m'>Mills</a>, <a href='/d'>dams</a> and <a href='/w'>weirs</a> stand near the <a href='/r'>river</a>.",
        "The <a href='/m'>mill of Vel</a> and the <a href='/d'>dam of Lun</a> remain",
        "<a href='/m'>Mill</a> and <a href='/d'>dam</a>, <a href='/x'>weir</a>, <a href='/y'>lock</a>.",
        "<a href='/m'>One headline that is a link</a>",
        "Yes",
        "7",
    ],
)
@pytest.mark.parametrize("n", [1, 40])
def test_ratios_keep_linked_sentences_and_short_lines(text, n):
    plain = re.sub("<[^>]*>", "", text)
    for tag in ("section", "p", "dd"):
        for body in (f"{LONG * n}<{tag}>{text}</{tag}>", f"<{tag}>{text}</{tag}>{LONG * n}", f"{LONG * n}<h2>A</h2><article>B</article><{tag}>{text}</{tag}><article>C</article>", f"{LONG * n}<{tag}>{text}</{tag}><{tag}>x</{tag}>"):
            assert plain in clean(body).split("\n")
    assert clean(f"{LONG}<p><a href='/a'>The mill stands, it is said.</a></p><p><a href='/b'>The dam fell.</a></p>").endswith("said.\n\nThe dam fell.")


PIECES = st.sampled_from(["<p>", "</p>", "<b", "</", "{{", "}}", "[[", "]]", "{|", "|}", "|", "\n", "```", "$", "\\begin{x}", "\\end{x}", "\\item ", "{", "}", "&lt;", "&#46;", "**", "''", "'''", "# ", "==", "> ", "text, more.", "한글 ", "<!--", "-->", "[a](b)", "\\[", "\\]", "<pre>", "<math>", "=====", "|---|"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_any_text_is_read(pieces):
    text, kinds = convert("".join(pieces))
    assert isinstance(text, str) and set(kinds) <= {"html", "markdown", "wiki", "latex"}


@pytest.mark.parametrize("part", ["\\[ ", "\\(a ", "$$a ", "{{a ", "[[a ", "**a ", "''a ", "<a ", "`", "|a\n", "&lt;", "\\a{", "{|\n", "<!--", "# a\n", "word. "])
def test_long_unclosed_markup(part):
    assert isinstance(convert(part * 30_000)[0], str)


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "<p>a</p>"), (3, "<p>a</p>"), (None, "x"), (5, "<p>" + "word, " * 20_000 + "</p>")]
    df = spark.createDataFrame([(*r, "q", "r") for r in rows], "doc_id int, body string, text string, kinds string")
    got = clean_bodies(df, "doc_id", "body").collect()
    shown = sorted((str(r.doc_id), r.text if r.doc_id != 5 else len(r.text), r.kinds) for r in got)
    assert shown == [("1", None, []), ("2", "", []), ("3", "a", ["html"]), ("3", "a", ["html"]), ("5", 119_999, ["html"]), ("None", "x", [])]
    assert clean_bodies(df.limit(0), "doc_id", "body").collect() == []
