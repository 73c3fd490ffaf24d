"""Problem 2: text without foreign markup, its structure kept.

A record is scanned once into nodes: runs of text and pieces of markup, each with the path of tags it stands
in. Method: tag-path ratios. For every root-to-leaf path of a record the text length and the punctuation of its
nodes are summed and taken per node; both ratios are fused, smoothed along the record, and stretches of a path below
the threshold are residue, such as rows of links around an article. The outliner's own text and every structural piece (heading,
list, code, formula, table, paragraph) with all text inside it are content whatever their ratio. Clean text is
written from the content nodes, as Markdown.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags and commands by what they write.
HTML_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
HTML_LISTS = frozenset("ul ol li dl dt dd menu dir".split())
HTML_TABLES = frozenset("table thead tbody tfoot tr td th caption colgroup col".split())
HTML_CODE = frozenset("pre xmp listing plaintext".split())
HTML_INLINE = frozenset(
    """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button
    canvas center cite code data datalist del details dfn dialog div em embed fieldset figcaption figure font footer form
    frame frameset head header hr html i iframe img input ins kbd label legend link main map mark marquee meta meter nav nobr
    noframes noscript object optgroup option output p param picture progress q rp rt ruby s samp script section select small
    source span strike strong style sub summary sup svg template textarea time title track tt u var video wbr""".split()
)
HTML_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LATEX_HEADINGS = frozenset("part chapter section subsection subsubsection paragraph subparagraph title".split())
LATEX_LISTS = frozenset("itemize enumerate description".split())
LATEX_CODE = frozenset("verbatim Verbatim lstlisting minted alltt".split())
LATEX_TABLES = frozenset("tabular tabularx tabulary longtable table array supertabular".split())
LATEX_FORMULAS = frozenset(
    "equation align gather multline eqnarray displaymath math flalign alignat split aligned cases matrix pmatrix bmatrix vmatrix".split()
)
LATEX_WITH_ARGUMENT = frozenset(
    """textbf textit textsl textsc texttt textsf textrm textsuperscript textsubscript emph underline uline sout mbox fbox cite
    citep citet citealp autocite parencite ref eqref pageref autoref cref nameref label footnote footnotetext footnotemark
    endnote marginpar href url nolinkurl caption includegraphics input include bibliography bibliographystyle author date
    thanks index gls hspace vspace color textcolor colorbox hyperref usepackage documentclass newcommand mathrm""".split()
)
LATEX_BARE = frozenset(
    """noindent newline linebreak newpage pagebreak clearpage maketitle tableofcontents LaTeX TeX ldots dots hline par
    bigskip medskip smallskip centering hfill vfill hrule textbackslash appendix""".split()
)
WIKI_SWITCHES = frozenset(
    "NOTOC TOC FORCETOC NOEDITSECTION NOINDEX INDEX NOGALLERY NEWSECTIONLINK NONEWSECTIONLINK HIDDENCAT STATICREDIRECT NOTITLECONVERT NOCONTENTCONVERT".split()
)

#: Tags whose text is part of a structure.
_STRUCTURE = frozenset(
    [f"html:{t}" for t in HTML_HEADINGS | HTML_LISTS | HTML_TABLES | HTML_CODE]
    + ["html:p", "html:blockquote", "html:figcaption", "html:summary"]
    + [f"latex:{t.lower()}" for t in LATEX_LISTS | LATEX_CODE | LATEX_TABLES | LATEX_FORMULAS]
)

_MASTER = re.compile(
    r"""
      (?P<fence>^[ \t>]*(?:[-*+][ ])?(?P<f>`{3,}|~{3,})[^\n]*(?:\n.*?(?:^[ \t>]*(?P=f)[`~]*[ \t]*\r?$|\Z)|\Z))
    | (?P<span>(?P<s>`+)(?!`)[^\n]*?(?<!`)(?P=s)(?!`))
    | (?P<comment><!--.*?(?:-->|\Z))
    | (?P<wmath><(?:math|chem)\b[^>]*>.*?</(?:math|chem)\s*>)
    | (?P<wcode><(?P<wc>syntaxhighlight|source)\b[^>]*>.*?</(?P=wc)\s*>)
    | (?P<wref><ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>|</?references\b[^>]*>|<nowiki\s*/>|<nowiki>.*?</nowiki>|</?(?:gallery|poem|onlyinclude|noinclude|includeonly)\b[^>]*>)
    | (?P<hpre><(?P<hp>pre|xmp|listing)\b[^>]*>.*?(?:</(?P=hp)\s*>|\Z))
    | (?P<hraw><(?P<hr>script|style)\b[^>]*>.*?</(?P=hr)\s*>)
    | (?P<htable><table\b[^>]*>.*?(?:</table\s*>|(?=\n[ \t]*\n)|\Z))
    | (?P<tag></?(?P<t>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*|\s*/)?>)
    | (?P<entity>&(?:[A-Za-z][A-Za-z0-9]{1,31}|\#[0-9]{1,7}|\#[xX][0-9A-Fa-f]{1,6});)
    | (?P<wtable>^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z))
    | (?P<lblock>\\begin\{(?P<e>[A-Za-z]+)\*?\}(?P<lbody>.*?)\\end\{(?P=e)\*?\})
    | (?P<lenv>\\(?:begin|end)\{(?P<le>[A-Za-z]+)\*?\}(?:\[[^\]\n]*\])?)
    | (?P<display>\$\$(?!\$)[^$]+?\$\$|\\\[.+?\\\])
    | (?P<imath>\\\([^\n]+?\\\)|(?<![\\\w$])\$(?![\s$])(?P<m>[^$\n]+?)(?<![\s\\])\$(?![\w$]))
    | (?P<lcmd>\\(?P<c>[A-Za-z]+)\*?(?:(?:\[[^\]\n]*\])*(?P<arg>\{)|(?![A-Za-z{])))
    | (?P<whead>^[ \t]*(?P<eq>={2,6})(?P<wh>[ ]?(?:(?!==)[^\n])*?[^=\s][ ]?)(?P=eq)[ \t]*\r?$)
    | (?P<wlist>^(?!\#+[ ])[*\#:;]{2,}[ ]?(?=\S)(?<=[ ]))
    | (?P<wquote>(?<!')(?P<q>'{2}(?:'(?:'')?)?)(?=[^'\s])[^'\n]*(?:'[^'\n]+)*?(?P=q)(?!'))
    | (?P<wlink>(?<!\[)\[(?P<url>(?:https?:|ftp:|mailto:)?//[^\s\]]+)[ ]+(?P<label>[^\]\n]+)\](?!\())
    | (?P<wswitch>__(?P<sw>[A-Z]{3,})__)
    | (?P<wredirect>^\#(?:REDIRECT|redirect)\b)
    """,
    re.X | re.S | re.M | re.I,
)
_FORMULA = re.compile(r"[\\^_={}<>+*/|]|^[A-Za-z]\w?'?$").search
_HINT = re.compile(r"[<&\\$]|''|==|\{\||\[(?:https?:|ftp:|mailto:)?//|__[A-Z]|^[ \t]*[*#:;]{2,} |^#REDIRECT", re.M | re.I).search
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？()«»„“”\"'-]").findall


@dataclass(slots=True)
class Node:
    """A run of text or a piece of markup of a record."""

    start: int
    end: int
    path: int  # number of the tag path it stands in, 0 outside of all tags
    inside: bool = False  # within a structure
    markup: str = ""  # '' for the record's own text
    element: str = ""
    text: str = ""  # what is read where the piece stands


def may_have_markup(text: str) -> bool:
    """Whether a record can have any foreign markup; a quick test that never misses."""
    return _HINT(text) is not None


class _Stack:
    """The open tags. Each path of tags has a number, whatever its depth, so that nodes of one path are found without its names."""

    def __init__(self) -> None:
        self.ids: dict[tuple[int, str], int] = {}
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]
        self.times: dict[str, int] = {}

    def enter(self, name: str) -> None:
        _, at, inside = self.open[-1]
        path = self.ids.setdefault((at, name), len(self.ids) + 1)
        self.open.append((name, path, inside or name in _STRUCTURE))
        self.times[name] = self.times.get(name, 0) + 1

    def leave(self, name: str) -> None:
        """Ends the innermost tag of the name with all within it; nothing if there is none."""
        found = not self.times.get(name)
        while not found:
            last, _, _ = self.open.pop()
            self.times[last] -= 1
            found = last == name

    def node(self, start: int, end: int, text: str) -> Node:
        _, path, inside = self.open[-1]
        return Node(start, end, path, inside, text=text)


def scan(text: str) -> list[Node]:
    """Nodes of a record in order; together they cover it."""
    nodes: list[Node] = []
    stack = _Stack()
    done = 0
    at = 0
    while (m := _MASTER.search(text, at)) is not None:
        node = _piece(m, stack)
        at = max(m.end(), m.start() + 1) if node is not None or m.lastgroup is None else m.start() + 1
        if node is None:
            continue
        if node.start > done:
            nodes.append(stack.node(done, node.start, text[done : node.start]))
        _enter(node, m, stack)
        nodes.append(node)
        done = at = node.end
    if done < len(text):
        nodes.append(stack.node(done, len(text), text[done:]))
    return nodes


def _piece(m: re.Match, stack: _Stack) -> Node | None:
    """What a match of the master pattern is; None if it is none of the markup looked for."""
    g = m.group
    node = stack.node(m.start(), m.end(), g())
    if g("fence") is not None or g("span") is not None:
        return node
    if g("comment") is not None:
        return node
    if g("wmath") is not None:
        return _as(node, "wiki", "formula", "$" + _inside(g()) + "$")
    if g("wcode") is not None:
        return _as(node, "wiki", "code", _fenced(_inside(g())))
    if g("wref") is not None:
        return _as(node, "wiki", "inline", _inside(g()) if g().lower().startswith("<nowiki") else "")
    if g("hpre") is not None:
        return _as(node, "html", "code", _fenced(html.unescape(re.sub(r"<[^<>]*>", "", _inside(g())))))
    if g("hraw") is not None:
        return _as(node, "html", "inline", "")
    if g("htable") is not None:
        return _as(node, "html", "table", _html_table(g()))
    if g("tag") is not None:
        return _tag(node, m)
    if g("entity") is not None:
        if g()[1] != "#" and g()[1:] not in html5:
            return None
        return _as(node, "html", "inline", html.unescape(g()))
    if g("wtable") is not None:
        return _as(node, "wiki", "table", _wiki_table(g()))
    if g("lblock") is not None:
        return _environment(node, m)
    if g("lenv") is not None:
        element = "list" if g("le").lower() in LATEX_LISTS else "inline"
        return _as(node, "latex", element, "")
    if g("display") is not None:
        return _as(node, "latex", "formula", "$$" + g()[2:-2].strip() + "$$")
    if g("imath") is not None:
        body = g("m") if g("m") is not None else g()[2:-2]
        if g("m") is not None and not _FORMULA(body):
            return None
        return _as(node, "latex", "formula", f"${body.strip()}$")
    if g("lcmd") is not None:
        return _command(node, m)
    if g("whead") is not None:
        return _as(node, "wiki", "heading", "#" * len(g("eq")) + " " + g("wh").strip())
    if g("wlist") is not None:
        marks = g().strip()
        return _as(node, "wiki", "list", "\t" * (len(marks) - 1) + ("1. " if marks[-1] == "#" else "- "))
    if g("wquote") is not None:
        n = len(g("q"))
        mark = {2: "*", 3: "**"}.get(n, "***")
        return _as(node, "wiki", "inline", mark + g()[n:-n] + mark)
    if g("wlink") is not None:
        return _as(node, "wiki", "inline", f"[{g('label')}]({g('url')})")
    if g("wswitch") is not None:
        return _as(node, "wiki", "inline", "") if g("sw") in WIKI_SWITCHES else None
    return _as(node, "wiki", "inline", "") if g("wredirect") is not None else None


def _as(node: Node, markup: str, element: str, text: str) -> Node:
    node.markup, node.element, node.text = markup, element, text
    return node


def _inside(tagged: str) -> str:
    """The content between the first and the last tag."""
    return tagged[tagged.index(">") + 1 : tagged.rindex("<")] if tagged.rindex("<") > 0 else tagged[tagged.index(">") + 1 :]


def _fenced(code: str) -> str:
    return "\n```\n" + code.strip("\n") + "\n```\n"


def _tag(node: Node, m: re.Match) -> Node | None:
    name = m["t"]
    low = name.lower()
    if name in ("Region", "SectionHeading"):
        return node
    close = m.group().startswith("</")
    if low in HTML_HEADINGS:
        return _as(node, "html", "heading", "\n" if close else "\n" + "#" * (int(low[1]) if low[1].isdigit() else 2) + " ")
    if low in HTML_LISTS:
        return _as(node, "html", "list", "\n- " if low in ("li", "dt", "dd") and not close else "")
    if low in HTML_TABLES:
        return _as(node, "html", "table", "\n" if low == "tr" else " | ")
    if low in HTML_CODE:
        return _as(node, "html", "code", "")
    if low in HTML_INLINE:
        return _as(node, "html", "inline", "\n" if low in ("br", "p", "div", "hr") else "")
    return None


def _environment(node: Node, m: re.Match) -> Node | None:
    name = m["e"]
    low = name.lower()
    if name in LATEX_CODE or low in LATEX_CODE:
        return _as(node, "latex", "code", _fenced(re.sub(r"^(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?\n", "", m["lbody"])))
    if low in LATEX_FORMULAS:
        return _as(node, "latex", "formula", "\n$$" + m["lbody"].strip() + "$$\n")
    if low in LATEX_TABLES:
        return _as(node, "latex", "table", _latex_table(m["lbody"]))
    opening = re.match(r"\\begin\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?", m.group())
    node.end = node.start + opening.end()
    return _as(node, "latex", "list" if low in LATEX_LISTS else "inline", "")


_argument = re.compile(r"\{((?:[^{}]|\{[^{}]*\})*)\}").match


def _command(node: Node, m: re.Match) -> Node | None:
    name, text = m["c"], m.string
    if m["arg"] is None:
        if name == "item":
            return _as(node, "latex", "list", "- ")
        before = text[m.start() - 1] if m.start() else " "
        if name in LATEX_BARE and not (before.isalnum() or before in ":\\/"):
            return _as(node, "latex", "inline", "")
        return None
    if name == "item":
        return _as(node, "latex", "list", "- ")
    argument = _argument(text, m.end() - 1)
    inner = argument[1] if argument else ""
    if argument:
        node.end = argument.end()
    if name in LATEX_HEADINGS:
        level = {"part": 1, "chapter": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4}.get(name, 5)
        return _as(node, "latex", "heading", "#" * level + " " + inner)
    if name in LATEX_WITH_ARGUMENT:
        bold = {"textbf": f"**{inner}**", "emph": f"*{inner}*", "textit": f"*{inner}*", "texttt": f"`{inner}`"}
        dropped = name.startswith(("cite", "ref", "label", "eqref", "page", "bib", "use", "document", "include", "vspace", "hspace"))
        return _as(node, "latex", "inline", "" if dropped else f" ({inner})" if "note" in name else bold.get(name, inner))
    return None


def _html_table(text: str) -> str:
    rows = re.split(r"(?i)<tr\b[^>]*>", text)[1:]
    cells = [[html.unescape(re.sub(r"<[^<>]*>", " ", c)).strip() for c in re.split(r"(?i)<t[dh]\b[^>]*>", r)[1:]] for r in rows]
    return _table(cells)


def _wiki_table(text: str) -> str:
    rows = re.split(r"(?m)^[ \t]*\|-.*$", text)
    cells = []
    for row in rows:
        line = [c.strip() for x in re.findall(r"(?m)^[ \t]*[|!](?![}\-+])(.*)$", row) for c in re.split(r"\|\||!!", x)]
        cells.append(line)
    return _table(cells)


def _latex_table(text: str) -> str:
    body = re.sub(r"^(?:\[[^\]\n]*\])?\{[^}\n]*\}|\\hline|\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})?", "", text)
    return _table([[c.strip() for c in row.split("&")] for row in body.split("\\\\")])


def _table(cells: list[list[str]]) -> str:
    rows = [r for r in cells if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    lines.insert(1, "|" + "---|" * width)
    return "\n" + "\n".join(lines) + "\n"


def _enter(node: Node, m: re.Match, stack: _Stack) -> None:
    """Keeps the path of open tags; a closing tag ends the innermost of its name, if there is one."""
    if m["tag"] is not None:
        name = m["t"].lower()
        if m.group().startswith("</"):
            stack.leave("html:" + name)
        elif name not in HTML_VOID and not m.group().endswith("/>"):
            stack.enter("html:" + name)
    elif m["lblock"] is not None and node.element in ("list", "inline"):
        stack.enter("latex:" + m["e"].lower())
    elif m["lenv"] is not None and m.group().startswith("\\end"):
        stack.leave("latex:" + m["le"].lower())


def elements(text: str | None) -> list[tuple[str, str]]:
    """Each (markup, element) that a record has, once, sorted."""
    if not text or not may_have_markup(text):
        return []
    return sorted({(n.markup, n.element) for n in scan(text) if n.markup})


def path_ratios(nodes: list[Node]) -> dict[int, tuple[int, float]]:
    """Number of text nodes of every path, and its fused ratio: text length per node, weighed by punctuation per node."""
    sums: dict[int, list[int]] = {}
    for n in nodes:
        if not n.markup and (words := n.text.strip()):
            row = sums.setdefault(n.path, [0, 0, 0])
            row[0] += 1
            row[1] += len(words)
            row[2] += len(_PUNCTUATION(words))
    return {p: (k, size / k * (1 + marks / k)) for p, (k, size, marks) in sums.items()}


def residue(nodes: list[Node], least: float = 24.0, times: int = 3) -> set[int]:
    """Start of every text node of a record that is residue.

    A path can be residue if it has at least ``times`` text nodes, is no part of a structure and isn't the record's
    own text. Its ratio is smoothed with that of each stretch of its nodes that no other text interrupts: stretches
    of at least ``times`` nodes below ``least`` (signs per node, weighed by punctuation) are residue, a link within a
    sentence is not. There is none unless a path of the record has twice that ratio: short pieces alone are
    a record, not what surrounds one. No bound depends on the length of the record.
    """
    ratio = path_ratios(nodes)
    structured = {n.path for n in nodes if n.inside}
    judged = {p for p, (k, _) in ratio.items() if k >= times and p and p not in structured}
    if not judged or max(r for _, r in ratio.values()) < 2 * least:
        return set()
    out: set[int] = set()
    texts = [n for n in nodes if not n.markup and n.text.strip()]
    for path, stretch in groupby(texts, key=lambda n: n.path):
        if path in judged and len(row := list(stretch)) >= times:
            (_, own), (_, whole) = path_ratios(row)[path], ratio[path]
            if (own + whole) / 2 < least:
                out.update(n.start for n in row)
    return out


def clean(text: str | None, least: float = 24.0) -> str | None:
    """The record's text as Markdown without foreign markup; null stays null.

    Residue (:func:`residue`) is left out; text inside a heading, list, table, paragraph or code block never is,
    however short it is and whatever stands beside it.
    """
    if not text or not may_have_markup(text):
        return text
    nodes = scan(text)
    drop = residue(nodes, least)
    out = "".join(n.text for n in nodes if n.start not in drop)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", out)).strip("\n")


def _latest(found: DataFrame, key: str, value: str) -> DataFrame:
    when = F.coalesce(F.col("loaded_at").cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    return found.groupBy(key).agg(F.max_by(value, when).alias(value))


def markup_elements(records: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``markup``, ``element``): each kind of foreign markup a record has, once.

    ``records`` may hold several deliveries of a record (``loaded_at``); the last one counts. Texts are read
    where they lie and never shuffled: only the few element names of each delivery are. Null, empty and plain
    texts give nothing, rows without a key are left out, an empty table gives an empty result. Unclosed markup
    reaches to the end of its block.
    """
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [["/".join(x) for x in elements(t)] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=[key, "loaded_at", "found"]
            )

    when = records.schema["loaded_at"].dataType.simpleString()
    per_row = (
        records.select(F.col(key), F.col("loaded_at"), F.col(text).alias("text"))
        .filter(F.col(key).isNotNull())
        .mapInArrow(run, f"{key} {kind}, loaded_at {when}, found array<string>")
    )
    return _latest(per_row, key, "found").select(key, F.explode("found").alias("x")).select(
        key, F.split_part("x", F.lit("/"), F.lit(1)).alias("markup"), F.split_part("x", F.lit("/"), F.lit(2)).alias("element")
    )


def clean_texts(records: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``clean``): the last delivery of every record with its text freed of foreign markup."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "clean"])

    rows = records.select(F.col(key), "loaded_at", F.col(text).alias("text")).filter(F.col(key).isNotNull())
    return _latest(rows, key, "text").select(key, "text").mapInArrow(run, f"{key} {kind}, clean string")
