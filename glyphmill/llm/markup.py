"""Clean text out of bodies that were taken over with HTML, Markdown, wiki or LaTeX markup.

A body is read into a sequence of leaves. Each leaf has a text, a role (text, heading, item, code, formula, cell), the kinds
of markup met in it and a root-to-leaf path of block elements, in one vocabulary for all four notations. Content is then
told from residue by tag-path ratios, path by path: letters, letters outside link lists and punctuation are summed per path and
divided by the number of its leaves, their logarithms are smoothed over the paths in document order and fused by
multiplication with a path's own, and paths whose fused value is below a share of what their letters would give without a link
are residue with all their leaves; punctuation is the root that is taken of the share. A path has a link list if it holds two
links or more, in one leaf or in several without punctuation. A path
through an element that never holds content (scripts, navigation, footers, template parameters, categories, references,
pictures' captions) has the value 0, as one of signs only. A path is not residue for being short: one word without a link has
the share 1 beside a page of any length; rows of links with a few words between them are below it, sentences with many links
above it, by their words and punctuation. Structure (headings, items, cells, code, formulas) stays on
every path that has not the value 0. Where no path is content, all visible text is.

Clean text writes a heading as `# ...` with its level, an item as `- ...` or with its number, indented by depth, code between
lines of three backticks with its language, a formula as it stands between dollar signs, cells of a row with ` | ` between
them. A body without markup comes out as it was stored.

Kinds: `html` tags, comments and character references, also escaped, cut off or inside other markup; `markdown` headings,
strong emphasis, links, images, quotes, fences, tables; `wiki` links, templates, bold, headings, tables; `latex` commands,
environments, formulas. They are read off the weighed paths, residue included. List bullets and numbers alone, comparison
signs, prices, carets, underscores, single asterisks, `#` before a number, lone ampersands, file paths, plain brackets and
single letters behind a backslash are no markup.

Markup is read to any depth, with an explicit stack. Each row is converted where it lies; nothing is shuffled. Defined
results: a null body has a null text and no kind, an empty or blank one itself and no kind; rows repeated are converted each
by itself; an empty table gives an empty table; columns not asked for are left out.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML and of the tags wikis add.
BLOCK_TAGS = "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form head header html li main nav ol p section select summary table tbody td tfoot th thead title tr ul references gallery"
INLINE_TAGS = "a abbr acronym audio b bdi bdo big br button cite del dfn em embed font hr i iframe img input ins kbd label link map mark math meta noscript nowiki object option param q ref s samp script small source span strike strong style sub sup svg syntaxhighlight textarea time tt u var video wbr pre code h1 h2 h3 h4 h5 h6"
KNOWN = frozenset(f"{BLOCK_TAGS} {INLINE_TAGS}".split())
BLOCKS = frozenset(BLOCK_TAGS.split())
BREAKS = frozenset(["br", "hr", "wbr"])
#: Elements whose text is its own path, though they stand inside a line.
ASIDE = frozenset(["ref", "script", "style", "noscript", "button", "select", "textarea"])
#: Path elements under which nothing is visible text, and those under which nothing is content.
HIDDEN = frozenset(["script", "style", "noscript"])
NO_CONTENT = HIDDEN | frozenset(["nav", "footer", "form", "button", "select", "textarea", "head", "template", "category", "reference", "ref", "references", "caption", "figcaption", "gallery"])
#: Templates whose text belongs to the sentence, with the numbers of the parameters that do.
INLINE_TEMPLATES = {"lang": (1,), "convert": (0, 1), "cvt": (0, 1), "nowrap": (0,), "small": (0,), "abbr": (0,)}
SECTIONS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
MATH = "equation|align|gather|multline|displaymath|math|eqnarray"
VERBATIM = "verbatim|lstlisting|minted|alltt"

#: Paths whose fused ratio is below this share of the one that their letters would have without a link are residue.
LEAST_SHARE = 0.26
SMOOTHING = np.array([0.25, 0.5, 0.25])

_NAMES = frozenset(n.rstrip(";") for n in html.entities.html5)
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});|&(?:nbsp|amp|lt|gt|quot)(?![A-Za-z0-9;=])")

_MASTER = re.compile(
    rf"""(?P<comment><!--.*?(?:-->|\Z)|<![A-Za-z][^<>]*(?:>|\Z))
    |(?P<fence>^[ ]{{0,3}}(?:```|~~~)(?P<language>[^\n]*)\n?(?P<fenced>.*?)(?:^[ ]{{0,3}}(?:```|~~~)[ ]*$|\Z))
    |(?P<pre><(?P<preTag>pre|syntaxhighlight)\b(?P<preAttrs>[^<>]*)>(?P<preText>.*?)(?:</(?P=preTag)\s*>|\Z))
    |(?P<code><code\b[^<>]*>(?P<codeText>.*?)(?:</code\s*>|\Z))
    |(?P<verbatim>\\begin\{{(?P<verb>{VERBATIM})\*?\}}(?P<verbText>.*?)(?:\\end\{{(?P=verb)\*?\}}|\Z))
    |(?P<equation>\\begin\{{(?P<env>{MATH})\*?\}}(?P<eqText>.*?)(?:\\end\{{(?P=env)\*?\}}|\Z))
    |(?P<math><math\b[^<>]*>(?P<mathText>.*?)(?:</math\s*>|\Z))
    |(?P<dollars>\$\$(?P<dd>.+?)\$\$|(?<![\w\\$])\$(?![\s$]|\d[\d.,]*_)(?P<d>[^$\n]*?[\\^_={{}}][^$\n]*?)(?<!\s)\$(?![\d$]))
    |(?P<bracketed>\\\[(?P<bd>(?:(?!\\\[).)+?)\\\]|\\\((?P<bi>(?:(?!\\\().)+?)\\\))
    |(?P<display>\{{\\displaystyle)
    |(?P<template>\{{\{{(?=\s*[^\W\d_]|\s*\#))
    |(?P<wtable>^\{{\|.*?(?:^\|\}}|\Z))
    |(?P<wlink>\[\[(?P<target>[^\[\]|\n]*)(?:\|(?P<label>[^\[\]\n]*))?(?:\]\]|\Z))
    |(?P<elink>\[https?://[^\s\]]+(?:[ ](?P<elabel>[^\]\n]*))?\])
    |(?P<image>!\[(?P<alt>[^\[\]]*)\]\([^()\s]*(?:\)|\Z))
    |(?P<link>\[(?P<text>[^\[\]]+)\]\([^()\s]*(?:\)|\Z))
    |(?P<quotes>'{{2,5}})(?=[^\s'])(?P<quoted>(?:(?!'')[^\n])+?)(?<!\s)(?P=quotes)(?!')
    |(?P<strong>(?P<mark>\*\*\*?|__|~~)(?=[^\s*_~])(?P<strongText>(?:(?!(?P=mark))[^\n])+?)(?<![\s*_~])(?P=mark)(?![*_~]))
    |(?P<wheading>^(?P<eq>={{2,6}})[ \t]*(?P<wtitle>[^=\n][^\n]*?)[ \t]*(?P=eq)[ \t]*$)
    |(?P<heading>^[ ]{{0,3}}(?P<hashes>\#{{1,6}})[ \t]+(?P<title>[^\s\d][^\n]*)$)
    |(?P<setext>^(?P<over>[^\s>|\-=][^\n]*)\n[ ]{{0,3}}(?P<under>={{3,}}|-{{3,}})[ \t]*$)
    |(?P<mtable>(?:^[ ]*\|[^\n]*\n)?^[ ]*\|?[ ]*:?-{{3,}}:?[ ]*(?:\|[ ]*:?-{{3,}}:?[ ]*)*\|[ ]*$(?:\n[ ]*\|[^\n]*)*)
    |(?P<quote>^[ ]{{0,3}}>[ ]+(?=[^\s\d]))
    |(?P<item>^(?P<indent>[ \t]*)(?P<bullet>[+\-]|\*{{1,5}}|\d{{1,3}}[.)])[ \t]+)
    |(?P<tie>~(?=\\[A-Za-z]))
    |(?P<environment>\\(?P<which>begin|end)\{{(?P<name>[A-Za-z]+\*?)\}}(?:\[[^\]\n]*\])?)
    |(?P<command>(?<![\w:\\.])\\(?P<cmd>[A-Za-z]+\*?)(?P<opt>\[[^\]\n]*\])?(?P<arg>\{{)?)
    |(?P<tag></?(?P<tagName>[A-Za-z][A-Za-z0-9]*)(?P<attrs>(?:\s[^<>]*)?)/?>)
    |(?P<cut><(?P<slash>/?)(?P<cutName>[A-Za-z][A-Za-z0-9]*)(?P<cutAttrs>(?:\s[^<>]*)?)(?=<|\Z))
    |(?P<blank>\n[ \t]*\n)""",
    re.X | re.S | re.M,
)
#: A body in which none of these stands needs no reading.
_SUSPECT = re.compile(r"[<&\\\[{|`$]|\*\*|__|~~|''|^[ ]{0,3}[#>=]|^-{3}", re.M)


class Leaf(NamedTuple):
    path: tuple[str, ...]
    role: str
    text: str
    level: int = 0
    mark: str = ""
    kinds: frozenset[str] = frozenset()
    linked: int = 0
    links: int = 0


@dataclass
class Pending:
    """The leaf that is being read."""

    role: str = "text"
    level: int = 0
    mark: str = ""
    words: list[str] = field(default_factory=list)
    kinds: set[str] = field(default_factory=set)
    linked: int = 0
    links: int = 0


class Source:
    """A text to be read, with the places of its braces looked up once."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def braces(self) -> dict[int, int]:
        """Place behind the brace that closes the one at a place."""
        found, open_ = {}, []
        for m in re.finditer(r"[{}]", self.text):
            if m[0] == "{":
                open_.append(m.start())
            elif open_:
                found[open_.pop()] = m.end()
        return found

    def closing(self, at: int, end: int) -> int:
        """Place behind the brace that closes the one at `at`, or `end` if none does before it."""
        return min(self.braces.get(at, end), end)


def _letters(text: str) -> int:
    return sum(map(str.isalnum, text))


def _remark(text: str, at: int) -> int:
    """Place behind a LaTeX remark that follows on the same line."""
    m = re.compile(r"[ \t]*%[^\n]*").match(text, at)
    return m.end() if m else at


def _is_tag(name: str, attrs: str) -> bool:
    return name.lower() in KNOWN or bool(re.match(r"\s+[A-Za-z][\w:-]*\s*=\s*[\"']", attrs or ""))


def _is_cut(name: str, slash: str, attrs: str) -> bool:
    if attrs.strip():
        return name.lower() in KNOWN or _is_tag(name, attrs)
    return bool(slash) or name.lower() in KNOWN or (len(name) > 1 and any(k.startswith(name.lower()) for k in KNOWN))


class Reader:
    """Reads one body into leaves, noting the kinds of markup met.

    A handler that meets text with further markup yields it (a source with start and end); the loop in `read` keeps the
    open handlers on a list, so depth costs no Python stack.
    """

    def __init__(self, body: str) -> None:
        self.leaves: list[Leaf] = []
        self.stack: list[str] = []
        self.now = Pending()
        self.in_link = False
        self.numbers: list[int] = []  # of the open lists, 0 for one without numbers
        self.row = 0
        self.read(Source(self.unescaped(body)))
        self.flush()

    def unescaped(self, body: str) -> str:
        """The body with escaped tags written out, however often they were escaped; other references are turned when a leaf is made."""
        while re.search(r"&(?:amp;)*(?:lt|#60|#x3[cC]);\s*/?(?:[A-Za-z][A-Za-z0-9]*|!--)", body):
            self.now.kinds.add("html")
            plain = re.sub(r"&(?:amp;)+(lt|gt|quot|#60|#62|#x3[cCeE]);", r"&\1;", body)
            plain = re.sub(r"&(?:lt|#60|#x3[cC]);(\s*/?[A-Za-z!][^&<>]*(?:&(?:quot|amp|nbsp);[^&<>]*)*)&(?:gt|#62|#x3[eE]);", lambda m: "<" + html.unescape(m[1]) + ">", plain)
            if plain == body:
                break
            body = plain
        return body

    def flush(self, role: str = "text", level: int = 0, mark: str = "") -> None:
        done, self.now = self.now, Pending(role, level, mark)
        text = "".join(done.words)
        for m in _REFERENCE.finditer(text):
            if m[0][1] == "#" or m[0][1:].rstrip(";") in _NAMES:
                done.kinds.add("html")
                text = html.unescape(text)
                break
        if text.strip() or done.kinds:
            self.leaves.append(Leaf((*self.stack,) or ("body",), done.role, text.strip(" \t\r\n"), done.level, done.mark, frozenset(done.kinds), done.linked, done.links))

    def leaf(self, name: str, role: str, text: str, mark: str = "") -> None:
        """A leaf of its own behind what was read so far; text goes on as before it."""
        kinds, self.now.kinds = self.now.kinds, set()
        after = self.now.role if self.now.role in ("item", "cell") and not "".join(self.now.words).strip() else "text"
        self.flush(after)
        text = text.strip("\n") if role == "code" else text.strip()
        self.leaves.append(Leaf((*self.stack, name), role, text, 0, mark, frozenset(kinds)))

    def say(self, text: str) -> None:
        self.now.words.append(text)
        if self.in_link:
            self.now.linked += _letters(text)

    def formula(self, text: str, display: bool) -> None:
        if display:
            self.leaf("formula", "formula", text)
        else:
            self.say(f"${text.strip()}$")

    def read(self, source: Source) -> None:
        open_ = [self.scan(source, 0, len(source.text))]
        while open_:
            inner = next(open_[-1], None)
            if inner is None:
                open_.pop()
            else:
                open_.append(self.scan(*inner))

    def scan(self, source: Source, at: int, end: int) -> Iterator[tuple[Source, int, int]]:
        while at < end and (m := _MASTER.search(source.text, at, end)):
            self.say(source.text[at : m.start()])
            group = m.lastgroup if m.lastgroup in _HANDLERS else next(g for g in _HANDLERS if m.group(g) is not None)
            stop = _HANDLERS[group](self, m, source, end)
            if isinstance(stop, Iterator):
                stop = yield from stop
            at = stop or m.end()
        self.say(source.text[at:end])

    def linked(self, source: Source, at: int, end: int) -> Iterator[tuple[Source, int, int]]:
        self.now.links += 1
        before, self.in_link = self.in_link, True
        yield source, at, end
        self.in_link = before

    def on_comment(self, m, source, end):
        self.now.kinds.add("html")

    def on_fence(self, m, source, end):
        self.now.kinds.add("markdown")
        self.leaf("code", "code", m["fenced"], m["language"].strip())

    def on_pre(self, m, source, end):
        self.now.kinds.add("html")
        attributes = m["preAttrs"] + "".join(re.findall(r"<code\b[^<>]*>", m["preText"]))
        language = re.search(r"lang(?:uage)?(?:-|\s*=\s*[\"']?)([A-Za-z0-9+#]+)", attributes)
        self.leaf("code", "code", html.unescape(re.sub(r"</?code\b[^<>]*>", "", m["preText"])), language[1] if language else "")

    def on_code(self, m, source, end):
        self.now.kinds.add("html")
        text = html.unescape(m["codeText"])
        if "\n" in text:
            self.leaf("code", "code", text)
        else:
            self.say(text)

    def on_verbatim(self, m, source, end):
        self.now.kinds.add("latex")
        options = re.match(r"\[[^\]\n]*\]|\{[^{}\n]*\}", m["verbText"]) if m["verb"] in ("lstlisting", "minted") else None
        language = re.search(r"(?:language=|\{)([A-Za-z0-9+#]+)", options[0]) if options else None
        self.leaf("code", "code", m["verbText"][options.end() if options else 0 :], language[1] if language else "")
        return _remark(source.text, m.end())

    def on_equation(self, m, source, end):
        self.now.kinds.add("latex")
        self.formula(m["eqText"], True)
        return _remark(source.text, m.end())

    def on_math(self, m, source, end):
        self.now.kinds.add("html")
        if re.search(r"\\[A-Za-z]|[\^_]\{?", m["mathText"]):
            self.now.kinds.add("latex")
        self.formula(html.unescape(m["mathText"]), False)

    def on_dollars(self, m, source, end):
        self.now.kinds.add("latex")
        self.formula(m["dd"] or m["d"], m["dd"] is not None)

    def on_bracketed(self, m, source, end):
        self.now.kinds.add("latex")
        self.formula(m["bd"] or m["bi"], m["bd"] is not None)

    def on_display(self, m, source, end):
        self.now.kinds.add("latex")
        close = source.closing(m.start(), end)
        self.formula(source.text[m.end() : close].removesuffix("}"), False)
        return close

    def on_template(self, m, source, end):
        self.now.kinds.add("wiki")
        close = source.closing(m.start(), end)
        name, *params = re.sub(r"[{}]{2}", " ", source.text[m.start() : close]).split("|")
        if (name := name.strip().lower()) in INLINE_TEMPLATES:
            self.say(" ".join(params[i].strip() for i in INLINE_TEMPLATES[name] if i < len(params)))
            return close
        outer, self.now = self.now, Pending()
        for text in params:
            self.stack += ["template", "parameter"]
            inner = Source(text.partition("=")[2] or text)
            yield inner, 0, len(inner.text)
            self.flush()
            del self.stack[-2:]
        self.now = outer
        return close

    def rows(self, rows: list[list[str]]):
        """Rows of a table, one leaf each."""
        self.flush()
        self.stack += ["table", "cell"]
        for cells in rows:
            if cells:
                self.row += 1
                self.now.role, self.now.level = "cell", self.row
                line = Source(" | ".join(cells))
                yield line, 0, len(line.text)
                self.flush()
        del self.stack[-2:]

    def on_wtable(self, m, source, end):
        self.now.kinds.add("wiki")
        rows = re.split(r"(?m)^\|-[^\n]*$", re.sub(r"^\{\|[^\n]*|^\|\}\Z", "", m[0], flags=re.M))
        bare = lambda c: re.sub(r"\A[^|\[\]{}]*=\s*\"[^\"|]*\"\s*\|(?!\|)", "", c.strip()).strip()
        yield from self.rows([[c for x in re.split(r"\|\||!!|^\|\+|^[|!]", row, flags=re.M) if (c := bare(x))] for row in rows])

    def on_wlink(self, m, source, end):
        self.now.kinds.add("wiki")
        if re.match(r"(?i)\s*(?:category|file|image|kategorie|catégorie|분류|カテゴリ|分类)\s*:", m["target"]):
            self.leaf("category", "text", m["label"] or m["target"])
            return
        self.now.links += 1
        text = m["label"] if m["label"] is not None else m["target"]
        self.now.linked += _letters(text)
        self.now.words.append(text)

    def on_elink(self, m, source, end):
        self.now.kinds.add("wiki")
        self.say(m["elabel"] or "")

    def on_image(self, m, source, end):
        self.now.kinds.add("markdown")
        self.leaf("caption", "text", m["alt"])

    def on_link(self, m, source, end):
        self.now.kinds.add("markdown")
        yield from self.linked(source, *m.span("text"))

    def on_quotes(self, m, source, end):
        self.now.kinds.add("wiki")
        yield source, *m.span("quoted")

    def on_strong(self, m, source, end):
        self.now.kinds.add("markdown")
        yield source, *m.span("strongText")

    def on_wheading(self, m, source, end):
        yield from self.titled("wiki", source, *m.span("wtitle"), len(m["eq"]))

    def on_heading(self, m, source, end):
        start, stop = m.span("title")
        yield from self.titled("markdown", source, start, start + len(source.text[start:stop].rstrip("# \t")), len(m["hashes"]))

    def on_setext(self, m, source, end):
        yield from self.titled("markdown", source, *m.span("over"), 1 if m["under"][0] == "=" else 2)

    def titled(self, kind: str, source: Source, at: int, end: int, level: int):
        self.flush("heading", level)
        self.now.kinds.add(kind)
        self.stack.append("heading")
        yield source, at, end
        self.flush()
        self.stack.pop()

    def on_mtable(self, m, source, end):
        self.now.kinds.add("markdown")
        yield from self.rows([[c.strip() for c in line.strip().strip("|").split("|") if c.strip(" :-")] for line in m[0].split("\n")])

    def on_quote(self, m, source, end):
        self.flush()
        self.now.kinds.add("markdown")

    def on_item(self, m, source, end):
        bullet = m["bullet"]
        depth = len(m["indent"].expandtabs(4)) // 2 + (len(bullet) - 1 if bullet[0] == "*" else 0)
        self.flush("item", depth, bullet if bullet[0].isdigit() else "")
        line = source.text.find("\n", m.end(), end)
        stop = end if line < 0 else line
        yield source, m.end(), stop
        self.flush()
        return stop

    def on_tie(self, m, source, end):
        self.say(" ")

    def listed(self) -> None:
        """Begin an item of the innermost list."""
        number = self.numbers[-1] if self.numbers else 0
        if number:
            self.numbers[-1] += 1
        self.flush("item", max(0, len(self.numbers) - 1), f"{number}." if number else "")

    def on_environment(self, m, source, end):
        self.now.kinds.add("latex")
        self.flush()
        name = m["name"].rstrip("*")
        is_list = name in ("itemize", "enumerate", "description")
        if m["which"] == "begin":
            self.stack.append(name)
            self.numbers += [int(name == "enumerate")] * is_list
        elif name in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(name) :]
            del self.numbers[len(self.numbers) - is_list :]
        return _remark(source.text, m.end())

    def on_command(self, m, source, end):
        name = m["cmd"].rstrip("*")
        if len(name) == 1 and not m["arg"]:  # \n, \t and the like
            self.say(m[0])
            return m.end()
        if name == "item":
            self.listed()
            self.now.kinds.add("latex")
            return m.end() - bool(m["arg"])
        self.now.kinds.add("latex")
        if not m["arg"]:
            return m.end()
        close = source.closing(m.end() - 1, end)
        stop = close - (source.text[close - 1] == "}" and close > m.end())
        if name in SECTIONS:
            yield from self.titled("latex", source, m.end(), stop, SECTIONS[name])
        elif name in ("cite", "ref", "label", "includegraphics", "usepackage", "documentclass", "bibliography", "index", "citep", "citet", "footnote"):
            self.leaf("reference", "text", source.text[m.end() : stop])
        elif name == "href" and source.text[close : close + 1] == "{":
            close = source.closing(at := close, end)
            yield from self.linked(source, at + 1, close - (source.text[close - 1] == "}"))
        else:
            yield source, m.end(), stop
        return close

    def on_tag(self, m, source, end):
        name = m["tagName"].lower()
        if not _is_tag(name, m["attrs"]):
            self.say(m[0])
            return
        self.now.kinds.add("html")
        closing, single = m[0].startswith("</"), m[0].endswith("/>")
        if name == "wbr":
            return
        if name in BREAKS:
            self.say("\n")
        elif name == "a":
            self.in_link = not closing and not single
            self.now.links += self.in_link
        elif re.fullmatch(r"h[1-6]", name):
            self.flush("text" if closing else "heading", int(name[1]))
            self.stack = [s for s in self.stack if s != "heading"] + ["heading"] * (not closing)
        elif name in BLOCKS or name in ASIDE:
            self.block(name, closing, single)

    def block(self, name: str, closing: bool, single: bool) -> None:
        """A block element begins or ends."""
        waiting = self.now.role if self.now.role == "item" and not "".join(self.now.words).strip() else ""
        level, mark = self.now.level, self.now.mark
        self.flush()
        if closing:
            if name in self.stack:
                del self.stack[len(self.stack) - 1 - self.stack[::-1].index(name) :]
            if name in ("ul", "ol") and self.numbers:
                self.numbers.pop()
        elif not single:
            if name in ("p", "li", "td", "th", "tr") and name in self.stack[-1:]:
                self.stack.pop()
            self.stack.append(name)
            if name in ("ul", "ol"):
                self.numbers.append(int(name == "ol"))
            if name == "tr":
                self.row += 1
        if name == "li" and not closing:
            self.listed()
        elif waiting and not closing and name not in ("ul", "ol"):
            self.now.role, self.now.level, self.now.mark = waiting, level, mark
        elif self.stack[-1:] and self.stack[-1] in ("td", "th"):
            self.now.role, self.now.level = "cell", self.row
        elif "li" in self.stack:
            self.now.role, self.now.level = "more", max(0, len(self.numbers) - 1)

    def on_cut(self, m, source, end):
        if _is_cut(m["cutName"], m["slash"], m["cutAttrs"]):
            self.now.kinds.add("html")
        else:
            self.say(m[0])

    def on_blank(self, m, source, end):
        self.flush()


_HANDLERS = {name[3:]: f for name, f in vars(Reader).items() if name.startswith("on_")}


def path_values(leaves: list[Leaf]) -> dict[tuple[str, ...], float]:
    """Fused tag-path ratio of each path, as a share of the one without links and punctuation; 0 for paths that never hold content."""
    at = {path: i for i, path in enumerate(dict.fromkeys(leaf.path for leaf in leaves))}
    letters, linked, links, marks, number = np.zeros((5, len(at)))
    for leaf in leaves:
        i, signs = at[leaf.path], len(re.findall(r"[.,;:!?。、，；：！？…।]", leaf.text))
        letters[i] += _letters(leaf.text)
        if leaf.links > 1 or not signs:  # one link with punctuation is a sentence
            linked[i] += leaf.linked
            links[i] += leaf.links
        marks[i] += signs
        number[i] += 1
    outside = np.where(links > 1, np.maximum(letters - linked, 0), letters)
    smooth = lambda x: np.convolve(np.pad(x, 1, "edge"), SMOOTHING, "valid")
    fused = lambda x: np.sqrt(x * smooth(x))
    own = np.log1p(outside / number) * outside / np.maximum(letters, 1)
    share = fused(own) / np.maximum(fused(np.log1p(letters / number)), 1e-9)
    values = share ** (1 / (1 + fused(np.log1p(marks / number))))
    values[[not NO_CONTENT.isdisjoint(path) for path in at]] = 0
    return {path: float(values[i]) for path, i in at.items()}


def weighed(leaves: list[Leaf]) -> list[tuple[Leaf, bool]]:
    """Every leaf with whether it is content, by tag-path ratios."""
    values = path_values(leaves)
    kept = [bool(leaf.text) and (values[leaf.path] >= LEAST_SHARE or (leaf.role != "text" and NO_CONTENT.isdisjoint(leaf.path))) for leaf in leaves]
    if not any(kept):
        kept = [bool(leaf.text) and HIDDEN.isdisjoint(leaf.path) for leaf in leaves]
    return list(zip(leaves, kept, strict=True))


def rendered(leaves: list[Leaf]) -> str:
    """Clean text of the leaves."""
    out = []
    for i, leaf in enumerate(leaves):
        text = leaf.text
        if leaf.role == "heading":
            text = "#" * max(1, leaf.level) + " " + " ".join(text.split())
        elif leaf.role == "item":
            text = "  " * leaf.level + f"{leaf.mark or '-'} {text}"
        elif leaf.role == "more":
            text = "  " * (leaf.level + 1) + text
        elif leaf.role == "code":
            text = f"```{leaf.mark}\n{text}\n```"
        elif leaf.role == "formula":
            text = f"$${text}$$"
        if i:
            before = leaves[i - 1]
            listed = leaf.role in ("item", "more") and before.role in ("item", "more")
            row = leaf.role == before.role == "cell"
            out.append(" | " if row and leaf.level == before.level else "\n" if listed or row else "\n\n")
        out.append(text)
    return "".join(out)


def convert(body: str) -> tuple[str, list[str]]:
    """Clean text and kinds of markup of a body."""
    if not _SUSPECT.search(body):
        return body, []
    leaves = weighed(Reader(body).leaves)
    kinds = sorted(frozenset().union(*(leaf.kinds for leaf, _ in leaves)))
    return (rendered([leaf for leaf, kept in leaves if kept]), kinds) if kinds else (body, [])


def clean_bodies(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """id_col, text (clean) and kinds (of the markup that the body held) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                done = [(None, []) if body is None else convert(body) for body in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))], [id_col, "text", "kinds"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    return df.select(id_col, F.col(body_col).alias("body")).mapInArrow(run, schema)
