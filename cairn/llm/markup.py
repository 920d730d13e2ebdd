"""Problem 1: markup residue in text documents, separated from content by minimum-cut labelling.

A text is read into nodes: candidates for markup (tags, references, commands, link brackets, emphasis marks, ...)
and the runs of text between them. Two classifiers give each node its log-odds of being markup or boilerplate: stated
weights by kind of candidate, and for text in an element tree a logistic regression (see ``boilerplate``) on link
density, length, little words, sentence ends and the elements around, fitted on a small labelled sample. The log-odds
become the terminal capacities of a flow network (source = residue, sink = content). Smoothness edges join candidates
on a line, on neighbouring lines and under the same construct (template, table, environment), and text runs by the
element tree: those of one block, and the neighbouring blocks of one parent. The minimum cut labels every node at the
least total cost, so weak candidates (a lone row of bars, an escaped percent sign) are residue beside firm markup of
their own kind and stay text elsewhere, and an entry of a menu goes the way of its menu, a short line that of its prose.

What the cut labels residue is converted: headings, list items, code blocks, formulas and table cells keep a plain
mark, links keep their text, boilerplate constructs (categories, redirects, scripts, comments, citations) vanish.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import boilerplate
from cairn.sources.tables import table

KINDS = ("html", "latex", "markdown", "wiki")
#: Smoothness between candidates of one kind: on one line, on neighbouring lines, under one construct.
SAME_LINE, NEXT_LINE, SAME_CONSTRUCT = 1.0, 0.8, 1.6
#: Smoothness between a candidate and the text run beside it.
BESIDE_TEXT = 0.1
#: Smoothness between text runs of one block, and between neighbouring blocks of one parent.
SAME_BLOCK, SIBLINGS = 2.0, 1.2
#: Log-odds of text outside any element tree.
PLAIN = -3.0

#: Element names (fixed values).
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt "
    "em embed fieldset figcaption figure font footer form frame frameset gallery h1 h2 h3 h4 h5 h6 head header hr html i iframe img includeonly input ins kbd label legend li link main map mark math meta meter nav "
    "noinclude noscript nowiki object ol onlyinclude optgroup option output p param picture poem pre progress q rb ref references rp rt ruby s samp script section select small source span strike strong style sub "
    "summary sup svg syntaxhighlight table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
#: Formula and text commands that are firm evidence by name (fixed values).
COMMANDS = frozenset(
    "alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega frac dfrac tfrac sqrt sum prod int "
    "lim log ln exp sin cos tan max min sup inf cdot times div pm mp leq geq le ge neq ne approx equiv sim in notin subset subseteq cup cap to rightarrow leftarrow Rightarrow mapsto infty partial nabla forall exists "
    "mathbb mathbf mathcal mathrm mathit operatorname text left right big Big hat bar vec tilde overline underline binom quad qquad ldots cdots dots begin end item section subsection subsubsection chapter part "
    "paragraph subparagraph emph textbf textit texttt textsc textrm bf it tt em sc rm sf ref eqref pageref cite citep citet label footnote caption includegraphics usepackage documentclass title author date maketitle "
    "newcommand def input include url href bibliography tableofcontents hline centering noindent newline linebreak newpage hspace vspace LaTeX TeX ss".split()
)
_ENVIRONMENT_MARK = {"verbatim": "\n```\n", "lstlisting": "\n```\n", "minted": "\n```\n", "equation": "$", "equation*": "$", "align": "$", "align*": "$", "displaymath": "$", "math": "$", "gather": "$", "eqnarray": "$"}
_BLOCK = frozenset("p div br hr table tr ul ol dl blockquote section article header footer main nav figure center body html head form details summary caption tbody thead".split())
_HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
_MAGIC = frozenset("TOC NOTOC FORCETOC NOEDITSECTION NEWSECTIONLINK NONUMBEREDHEADINGS HIDDENCAT INDEX NOINDEX STATICREDIRECT".split())
_DROP_SPACES = r"(?:category|kategorie|catégorie|categorie|カテゴリ|file|datei|fichier|ファイル|画像|image|bild|media)"


@dataclass
class Node:
    """A candidate (``kind`` set) or a text run: what it spans, how it renders as residue, its log-odds of being residue."""

    start: int
    end: int
    kind: str | None
    mark: str
    odds: float
    construct: int = -1
    drops: bool = False


class Spans:
    """Intervals of a text, merged; ``at in spans`` by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __contains__(self, at: int) -> bool:
        k = bisect_right(self.starts, at) - 1
        return k >= 0 and at < self.ends[k]


# ---------------------------------------------------------------- candidates

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*|/)?)(>|\Z)")
_DECL = re.compile(r"<!--.*?(?:-->|\Z)|<!(?:doctype|\[cdata\[)[^<>]*(?:>|\Z)|<\?(?:xml|php)[^<>]*(?:\?>|>|\Z)", re.IGNORECASE | re.DOTALL)
_SCRIPT = re.compile(r"<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.IGNORECASE | re.DOTALL)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_PATH = re.compile(r"(?<![A-Za-z])[A-Za-z]:\\[^\s\"'<>|]*|(?<!\S)\\\\[A-Za-z][\w.-]*\\[^\s\"'<>|]*")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?((?:\[[^\[\]\n]*\])?)(\{(?:[^{}\n]|\{[^{}\n]*\})*\}|\{[^{}\n]*\Z)?")
_FORMULA = re.compile(r"\\\[.*?(?:\\\]|\Z)|\\\(.*?(?:\\\)|\Z)|\$\$.*?(?:\$\$|\Z)", re.DOTALL)
_INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\w$])")
_ESCAPE = re.compile(r"\\([,;:!%&#_{}$|]|\\(?=\s|\Z|\[|\*))|(?<=[^\s~])~(?=\\[A-Za-z])")
_BRACED = re.compile(r"\{(?=\\(?:it|bf|em|tt|sc|rm|sf)\b)")

_LINK = re.compile(r"(\[\[:?)((?:[^\[\]\n|]*\|)?)([^\[\]\n]*)(\]\]|\Z)")
_FILE = re.compile(rf"\[\[\s*{_DROP_SPACES}\s*:[^\[\]\n]*(?:\]\]|\Z)", re.IGNORECASE)
_EXTERNAL = re.compile(r"\[(?:(?:https?|ftp):)?//[^\s\[\]]+((?:[ \t]+[^\[\]\n]*)?)(?:\]|\Z)|\[mailto:[^\s\[\]]+((?:[ \t]+[^\[\]\n]*)?)(?:\]|\Z)")
_TEMPLATE = re.compile(r"\{\{(?![{|!])|\}\}")
_REDIRECT = re.compile(r"^[ \t]*#(?:redirect(?:ion)?|weiterleitung|転送)\b[^\n]*", re.IGNORECASE | re.MULTILINE)
_QUOTES = re.compile(r"(?<!')('{5}|'{2,3})(?!')")
_WIKI_HEAD = re.compile(r"^(={1,6})(?!=)[ \t]*([^=\n](?:[^\n]*?[^=\n])?)[ \t]*(?:(\1)(?!=)[ \t]*\r?$|(={0,5}[ \t]*\Z))", re.MULTILINE)
_WIKI_TABLE = re.compile(r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^\n|]*$|\|\+[^\n]*|![^\n]*?(?:!!|\|\|)[^\n]*|\|(?![-}+|])[^\n]*?\|\|[^\n]*)", re.MULTILINE)
_WIKI_FIELD = re.compile(r"^[ \t]*\|[\w \t-]+=[^\n]*|^[ \t]*\|[ \t]*\w*\Z", re.MULTILINE)
_DEFINITION = re.compile(r"^;[ \t]*\S[^\n]*?[ \t]:[ \t]", re.MULTILINE)
_SIGNATURE = re.compile(r"(?<!~)~{4,5}(?!~)(?!\S*\n(?:.*\n)*?~{4})")
_MAGICS = re.compile(r"__([A-Z]{3,20})__")

_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(?=\S)|[ \t]+#{1,6}[ \t]*\r?$", re.MULTILINE)
_SETEXT = re.compile(r"^(?=[^\n]*[^\W_])(?![ \t]*[>|#={*-])[^\n]+\n {0,3}(={3,}|-{3,})[ \t]*\r?$", re.MULTILINE)
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n`]*$", re.MULTILINE)
_CODE = re.compile(r"(?<!`)`(?!`)[^`\n]+`(?!`)|(?<!`)``(?!`)[^\n]+?``(?!`)|(?<!`)`(?![`\s])[^`\n]*\Z")
_STRONG = re.compile(r"(?<![*\w\\])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![*\w])|(?<=[぀-鿿])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\3(?!\*)|(?<![*A-Za-z0-9\\])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\5(?=[぀-鿿])|(?<![*\w])\*\*(?=[^\s*])[^*\n]*\Z")
_UNDER = re.compile(r"(?<![A-Za-z0-9_\\/])(_{1,3})(?=[^\s_])([^_\n]*[^\s_])\1(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])__(?=[^\s_])[^_\n]*\Z")
_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])[^~\n]*[^\s~]~~(?!~)|(?<!~)~~(?=[^\s~])[^~\n]*\Z")
_MD_LINK = re.compile(r"(!?)\[([^\[\]\n]*)\](\((?:[^\s()]*(?:[ \t]+\"[^\"\n]*\")?\)|[^\s()]*\Z)|\[[^\[\]\n]*\])")
_FOOTNOTE = re.compile(r"\[\^[^\[\]\s]+\](?::[ \t]?)?|\[\^[^\[\]\s]*\Z")
_REFERENCE = re.compile(r"^ {0,3}\[[^\[\]\n^]+\]:[ \t]+\S+[^\n]*", re.MULTILINE)
_AUTOLINK = re.compile(r"<(?:https?|ftp|mailto):[^<>\s]*>")
_RULE_ROW = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*\r?$|^[ \t]*\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*\r?$", re.MULTILINE)
_BAR_ROW = re.compile(r"^[ \t]*\|(?![-}+|])[^\n]*\|[ \t]*\r?$", re.MULTILINE)
_QUOTE = re.compile(r"^ {0,3}>[ \t]?(?=\S)", re.MULTILINE)
_TASK = re.compile(r"^[ \t]*(?:[-*+]|\d+\.)[ \t]+\[[ xX]\][ \t]", re.MULTILINE)


def _html(text: str, out: list[Node], literal: list[tuple[int, int]]) -> None:
    for m in _DECL.finditer(text):
        out.append(Node(*m.span(), "html", "", 6.0, drops=True))
    for m in _SCRIPT.finditer(text):
        out.append(Node(*m.span(), "html", "", 6.0, drops=True))
    opened: list[tuple[str, int]] = []
    closed = {m[2] for m in _TAG.finditer(text) if m[1]}
    for m in _TAG.finditer(text):
        close, name, rest, ended = m[1], m[2].lower(), m[3], m[4]
        cut = not ended
        if name not in ELEMENTS:
            if not (cut and any(e.startswith(name) for e in ELEMENTS)) or m.start() and text[m.start() - 1].isascii() and text[m.start() - 1].isalnum():
                continue
        before = text[m.start() - 1] if m.start() else " "
        odds = 5.0
        if len(name) == 1 and not close and not rest and before.isascii() and (before.isalnum() or before == "_") and m[2] not in closed:
            odds = -3.0  # a type parameter
        if cut and not rest.strip() and name not in ELEMENTS:
            odds = 2.0
        if close:
            mark = {"pre": "\n```\n", "td": " | ", "th": " | ", "dt": ": "}.get(name, "\n" if name in _BLOCK or name in _HEADINGS or name in ("li", "dd") else "")
        elif name in _HEADINGS:
            mark = "\n" + "#" * _HEADINGS[name] + " "
        else:
            mark = {"li": "\n- ", "pre": "\n```\n", "dd": "\n- ", "dt": "\n"}.get(name, "\n" if name in _BLOCK else "")
        if name == "pre":
            if close and opened and opened[-1][0] == "pre":
                literal.append((opened.pop()[1], m.start()))
            elif not close:
                opened.append(("pre", m.end()))
        out.append(Node(*m.span(), "html", mark, odds))
    literal += [(start, len(text)) for name, start in opened]
    for m in _ENTITY.finditer(text):
        value = html.unescape(m[0])
        if value != m[0] and not value.endswith(";"):
            out.append(Node(*m.span(), "html", " " if value == "\xa0" else value, 5.0))


def _latex(text: str, out: list[Node], literal: list[tuple[int, int]]) -> None:
    paths = Spans([m.span() for m in _PATH.finditer(text)])
    spans = []
    for m in _FORMULA.finditer(text):
        inner = m[0].lstrip("\\$[(").rstrip("\\$])").strip()
        firm = bool(re.search(r"[\\^_=+<>|{}]|^\w$", inner))
        if m[0].startswith("$$") and not firm and not inner:
            continue
        out.append(Node(*m.span(), "latex", f"${inner}$", 5.0 if firm else 1.0))
        spans.append(m.span())
    displayed = Spans(spans)
    for m in _INLINE.finditer(text):
        if m.start() in displayed:
            continue
        firm = "\\" in m[1] or re.search(r"[\^_]\{?\w|=", m[1]) and not re.match(r"\d", m[1])
        single = re.fullmatch(r"[A-Za-z]", m[1])
        out.append(Node(*m.span(), "latex", m[0], 5.0 if firm else 1.0 if single else -3.0))
        if firm:
            spans.append(m.span())
    formulas = Spans(spans)
    begun = None
    for m in _COMMAND.finditer(text):
        if m.start() in paths:
            continue
        name, arg = m[1], (m[3] or "")[1:].removesuffix("}") if m[3] else ""
        known, braced = name in COMMANDS, bool(m[3])
        odds = 5.0 if known and (braced or len(name) > 2) else 3.0 if braced else 2.0 if known else 0.6 if len(name) > 3 else -0.5
        mark, end, drops = "", m.end(), False
        if name in ("begin", "end"):
            mark = _ENVIRONMENT_MARK.get(arg, "\n")
            if arg in ("verbatim", "lstlisting", "minted"):
                if name == "begin":
                    begun = m.end()
                elif begun is not None:
                    literal.append((begun, m.start()))
                    begun = None
        elif name == "item":
            mark, end = "\n- ", m.start(1) + 4
            end += len(text[end : end + 8]) - len(text[end : end + 8].lstrip(" "))
        elif name in ("chapter", "part", "section", "subsection", "subsubsection", "paragraph", "subparagraph", "title") and braced:
            level = {"chapter": 1, "part": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4}.get(name, 5)
            mark, drops = "\n" + "#" * level + " " + arg + "\n", True
        elif name in ("ref", "eqref", "pageref", "cite", "citep", "citet", "label", "usepackage", "documentclass", "bibliography", "includegraphics", "hspace", "vspace"):
            drops = True
        elif name == "footnote" and braced:
            mark, drops = f" ({arg})", True
        elif name == "href" and braced:
            mark, drops = "", True
        elif m.start() in formulas:
            out.append(Node(m.start(), m.start(1) + len(name), "latex", m[0], 5.0))
            continue
        elif braced and name in ("frac", "dfrac", "tfrac", "sqrt", "binom", "mathbb", "mathbf", "mathcal", "mathrm", "hat", "bar", "vec") or not braced and known and name not in ("it", "bf", "em", "tt", "sc", "rm", "sf"):
            mark, end = m[0][: m.start(1) + len(name) - m.start()], m.start(1) + len(name)  # formula source stays readable
        elif braced:
            mark, drops = arg, True
        out.append(Node(m.start(), end, "latex", mark, odds, drops=drops))
    if begun is not None:
        literal.append((begun, len(text)))
    covered = Spans([(n.start, n.end) for n in out if n.kind == "latex" and n.end - n.start > 1])
    for m in _BRACED.finditer(text):
        line_end = text.find("\n", m.end())
        close = text.find("}", m.end(), line_end if line_end >= 0 else len(text))
        out.append(Node(m.start(), m.end(), "latex", "", 4.0))
        if close > 0 and close not in covered:
            out.append(Node(close, close + 1, "latex", "", 3.0))
    for m in _ESCAPE.finditer(text):
        if m.start() in paths or m.start() in formulas:
            continue
        if m[0] == "~":
            out.append(Node(*m.span(), "latex", " ", 2.0))
        elif m[1] == "\\":
            out.append(Node(*m.span(), "latex", "\n", 1.5))
        else:
            out.append(Node(*m.span(), "latex", " " if m[1] in ",;:!" else m[1], 1.5 if m[1] in ",%&|{}" else 0.2))


def _wiki(text: str, out: list[Node], literal: list[tuple[int, int]]) -> None:
    quiet = Spans(literal)
    add = lambda *a, **k: None if a[0] in quiet else out.append(Node(a[0], a[1], "wiki", a[2], a[3], **k))
    for m in _REDIRECT.finditer(text):
        add(*m.span(), "", 5.0, drops=True)
    for m in _FILE.finditer(text):
        add(*m.span(), "", 5.0, drops=True)
    for m in _LINK.finditer(text):
        if not m[2] and not m[3].strip() and m[4] or m[4] and re.fullmatch(r"[\d\s,:-]+|[ijkxyn]", m[3]) and m.start() and text[m.start() - 1].isascii() and text[m.start() - 1].isalnum():
            continue
        shown = m.start(3)
        add(m.start(), shown, "", 5.0)
        if m[4]:
            add(m.start(4), m.end(4), "", 5.0)
    for m in _EXTERNAL.finditer(text):
        add(*m.span(), (m[1] or m[2] or "").strip(), 4.0, drops=True)
    stack: list[int] = []
    for m in _TEMPLATE.finditer(text):
        if m[0] == "{{":
            stack.append(m.start())
        elif stack:
            start = stack.pop()
            body = text[start + 2 : m.start()]
            name, _, rest = body.partition("|")
            if "{{" in rest or "\n" in rest:
                add(start, m.end(), "", 4.5, drops=True)
            elif re.fullmatch(r"\s*[\w .:/?#-]*", name):
                inline = name.strip().lower() in ("lang", "small", "big", "nowrap", "nobr", "ruby", "仮リンク", "transl")
                add(start, m.end(), rest.rpartition("|")[2] if inline else "", 4.5, drops=True)
    for start in stack:
        if re.match(r"\{\{\s*#?[\w]", text[start:]) or start + 2 == len(text):
            add(start, start + 2, "", 3.5)
    breaks = [m.start() for m in re.finditer("\n", text)] if "''" in text else []
    quotes: dict[int, int] = {}
    for m in _QUOTES.finditer(text):
        line = bisect_right(breaks, m.start())
        quotes[line] = quotes.get(line, 0) + 1
    for m in _QUOTES.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before.isdigit() and not after.strip():  # inches, seconds
            continue
        if not (before.strip() or after.strip()):
            continue
        paired = quotes[bisect_right(breaks, m.start())] > 1
        add(*m.span(), "", 4.0 if paired else 2.0 if after.strip() else 0.5)
    for m in _WIKI_HEAD.finditer(text):
        closed = m[3] is not None
        if not closed and (len(m[1]) < 2 or text[m.end() :].strip()):
            continue
        if closed and len(m[1]) == 1:
            continue
        add(m.start(1), m.start(2), "#" * len(m[1]) + " ", 4.5 if closed else 2.5)
        if closed:
            add(m.end(2), m.end(3), "", 4.5)
    for m in _WIKI_TABLE.finditer(text):
        row = m[0].strip()
        firm = row.startswith("{|") or row == "|}" or row.startswith("|-") or "!!" in row
        cells = [c.strip() for c in re.split(r"!!|\|\|", row.lstrip("|!"))]
        add(*m.span(), "" if row.startswith(("{|", "|}", "|-")) else " | ".join(cells), 4.0 if firm else 1.0)
    for m in _WIKI_FIELD.finditer(text):
        add(*m.span(), "", -0.4)
    for m in _DEFINITION.finditer(text):
        add(m.start(), m.start() + 1, "- ", 1.5)
    for m in _SIGNATURE.finditer(text):
        add(*m.span(), "", 2.0)
    for m in _MAGICS.finditer(text):
        if m[1] in _MAGIC:
            add(*m.span(), "", 4.0)


def _markdown(text: str, out: list[Node], literal: list[tuple[int, int]]) -> None:
    wiki = [(n.start, n.end) for n in out if n.kind == "wiki"]
    code: list[tuple[int, int]] = []
    opened: tuple[int, str] | None = None
    quiet = Spans(literal)
    for m in _FENCE.finditer(text):
        if m.start() in quiet or m[1][0] == "~" and m[0].strip("~ \r") == "" and opened is None and len(m[1]) > 3 and text.count(m[1]) < 2:
            continue
        if opened is None:
            opened = (m.end(), m[1])
        elif m[1].startswith(opened[1][0]) and m[0].strip().strip("`~") == "":
            code.append((opened[0], m.start()))
            opened = None
        else:
            continue
        out.append(Node(*m.span(), "markdown", "```", 4.0))
    if opened:
        code.append((opened[0], len(text)))
    literal += code
    taken = Spans(literal + wiki)
    referenced = re.search(r"^ {0,3}\[[^\[\]\n]+\]:", text, re.MULTILINE)
    add = lambda *a, **k: None if a[0] in taken else out.append(Node(a[0], a[1], "markdown", a[2], a[3], **k))
    for m in _ATX.finditer(text):
        if m[1]:
            add(*m.span(), m[1] + " ", 2.5)
        elif re.match(r"^ {0,3}#{1,6}[ \t]", text[text.rfind("\n", 0, m.start()) + 1 :]):
            add(*m.span(), "", 2.5)
    for m in _SETEXT.finditer(text):
        title = m[0].partition("\n")[0].strip()
        add(m.start(1), m.end(1), "", 3.0 if m[1][0] == "=" else 1.0 if abs(len(title) - len(m[1])) <= 6 else -1.0)
    for m in _CODE.finditer(text):
        add(*m.span(), m[0].strip("`"), 3.0)
    for pattern in (_STRONG, _UNDER):
        for m in pattern.finditer(text):
            if pattern is _UNDER and m[2] and m[2] in _MAGIC:
                continue
            marks = next((g for g in m.groups()[::2] if g), m[0][:2])
            words = m[0].strip(marks[0])
            firm = len(marks) > 1 or len(words) <= 60
            odds = 3.0 if len(marks) > 1 else 2.0 if firm else 0.2
            add(m.start(), m.start() + len(marks), "", odds)
            if m[0].endswith(marks) and len(m[0]) > 2 * len(marks):
                add(m.end() - len(marks), m.end(), "", odds)
    for m in _STRIKE.finditer(text):
        add(*m.span(), m[0].strip("~"), 3.0)
    for m in _MD_LINK.finditer(text):
        before = text[m.start() - 1] if m.start() else " "
        call = m[3].startswith("(") and before.isascii() and (before.isalnum() or before in "_)]") and not m[1]
        if m[3].startswith("[") and not referenced:
            continue
        add(*m.span(), m[2], -2.0 if call else 3.5, drops=True)
    for m in _FOOTNOTE.finditer(text):
        add(*m.span(), "", 3.5)
    for m in _REFERENCE.finditer(text):
        add(*m.span(), "", 2.0 if re.search(r"\]:[ \t]+(?:<|https?:|/|\.)", m[0]) else -2.0)
    for m in _AUTOLINK.finditer(text):
        add(*m.span(), m[0][1:-1], 3.0)
    for m in _RULE_ROW.finditer(text):
        add(*m.span(), "", 4.0)
    for m in _BAR_ROW.finditer(text):
        add(*m.span(), " | ".join(c.strip() for c in m[0].strip().strip("|").split("|")), 0.3)
    for m in _QUOTE.finditer(text):
        add(*m.span(), "", 1.5)
    for m in _TASK.finditer(text):
        add(*m.span(), "- ", 3.0)


# ---------------------------------------------------------------- minimum cut


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True = residue) that minimise sum of costs: -odds where residue, +odds where content, plus cut edges.

    Nodes whose log-odds outweigh all their edges keep their sign in every minimum cut; they are settled first and
    folded into their neighbours' capacities, which is exact. What remains goes through augmenting-path max-flow
    (shortest paths, as Edmonds and Karp). Ties go to content.
    """
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    pull = list(odds)
    label: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        k = queue.pop()
        if label[k] is not None:
            continue
        rest = sum(near[k].values())
        if abs(pull[k]) < rest or pull[k] == rest == 0 and near[k]:
            continue
        label[k] = pull[k] > 0
        for j, w in near[k].items():
            pull[j] += w if label[k] else -w
            del near[j][k]
            queue.append(j)
        near[k] = {}
    open_nodes = [k for k in range(n) if label[k] is None]
    if not open_nodes:
        return [bool(x) for x in label]
    s, t = n, n + 1
    room: dict[int, dict[int, float]] = {k: dict(near[k]) for k in open_nodes}
    room[s], room[t] = {}, {}
    for k in open_nodes:
        if pull[k] > 0:
            room[s][k] = pull[k]
            room[k].setdefault(s, 0.0)
        elif pull[k] < 0:
            room[k][t] = -pull[k]
            room[t].setdefault(k, 0.0)
    while True:
        back = {s: s}
        wave = [s]
        while wave and t not in back:
            following = []
            for a in wave:
                for b, w in room[a].items():
                    if w > 1e-9 and b not in back:
                        back[b] = a
                        following.append(b)
            wave = following
        if t not in back:
            break
        path, b = [], t
        while b != s:
            path.append((back[b], b))
            b = back[b]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] = room[b].get(a, 0.0) + flow
    for k in open_nodes:
        label[k] = k in back
    return [bool(x) for x in label]


# ---------------------------------------------------------------- labelling and rendering


def _constructs(text: str, nodes: list[Node]) -> None:
    """Give each candidate the construct that holds it: the wiki table, template, infobox or environment around it."""
    spans = [m.span() for m in re.finditer(r"^\{\|.*?(?:^\|\}|\Z)", text, re.MULTILINE | re.DOTALL)]
    spans += [m.span() for m in re.finditer(r"\{\{[^{}]*(?:\{\{[^{}]*\}\}[^{}]*)*(?:\}\}|\Z)", text)]
    spans += [m.span() for m in re.finditer(r"\\begin\{(\w+\*?)\}.*?(?:\\end\{\1\}|\Z)", text, re.DOTALL)]
    spans += [m.span() for m in re.finditer(r"^[ \t]*\|[^\n]*\|[ \t]*\r?\n[ \t]*\|[ \t:|-]+\|[ \t]*\r?(?:\n[ \t]*\|[^\n]*)*", text, re.MULTILINE)]
    spans.sort()
    held: list[tuple[int, int, int]] = []
    k = 0
    for n in nodes:
        while k < len(spans) and spans[k][0] <= n.start:
            held.append((*spans[k], k))
            k += 1
        held = [h for h in held if h[1] >= n.end or h[1] > n.start]
        if held:
            n.construct = held[-1][2]


def _tree(text: str, whole: list[Node], literal: Spans) -> list[tuple[int, int, float]]:
    """Give the text runs of an element tree their log-odds; returns their smoothness edges.

    The tree is the stack of open elements: an end tag closes up to its own element, an item, cell or paragraph the
    one before it. Code keeps its text.
    """
    tags = [(k, m) for k, n in enumerate(whole) if n.kind == "html" and n.odds > 0 and (m := _TAG.match(text, n.start)) and m.end() == n.end]
    if not tags:
        return []
    stack: list[tuple[str, int, bool, bool]] = []  # element, its number, boilerplate or content around
    blocks: dict[int, boilerplate.Block] = {}
    parents: dict[int, int] = {}
    homes: dict[int, int] = {}
    number, at = 0, 0
    events = iter([*tags, (len(whole), None)])
    k, m = next(events)
    while at < len(whole):
        if at == k:
            name = m[2].lower()
            if m[1]:
                if any(e[0] == name for e in stack):
                    while stack.pop()[0] != name:
                        pass
            elif name not in boilerplate.VOID and not m[3].rstrip().endswith("/"):
                if name in boilerplate.SELF_CLOSING and stack and stack[-1][0] == name:
                    stack.pop()
                number += 1
                role = boilerplate.role(name, m[3])
                above = stack[-1] if stack else ("", 0, False, False)
                parents[number] = next((e[1] for e in reversed(stack) if e[0] in boilerplate.BLOCKS), 0)
                stack.append((name, number, above[2] or role < 0, above[3] or role > 0))
            k, m = next(events)
        elif whole[at].kind is None and text[whole[at].start : whole[at].end].strip() and whole[at].start not in literal:
            home = next((e for e in reversed(stack) if e[0] in boilerplate.BLOCKS), None)
            if home is not None:
                block = blocks.setdefault(home[1], boilerplate.Block(home[2], home[3]))
                block.add(text[whole[at].start : whole[at].end], any(e[0] == "a" for e in stack))
                homes[at] = home[1]
        at += 1
    odds = {home: boilerplate.log_odds(block) for home, block in blocks.items()}
    edges: list[tuple[int, int, float]] = []
    before, under = -1, {}
    for at, home in homes.items():
        whole[at].odds = odds[home]
        if before >= 0 and homes[before] == home:
            edges.append((before, at, SAME_BLOCK))
        else:
            last = under.get(parents[home])
            if last is not None:
                edges.append((last, at, SIBLINGS))
        under[parents[home]] = before = at
    return edges


def label(text: str) -> tuple[list[Node], list[bool]]:
    """The nodes of a text in order and whether the minimum cut makes each residue."""
    nodes: list[Node] = []
    literal: list[tuple[int, int]] = []
    if "<" in text or "&" in text:
        _html(text, nodes, literal)
    if "\\" in text or "$" in text:
        _latex(text, nodes, literal)
    if re.search(r"\[[\[/hfm]|\{[{|]|''|^[ \t]*[|!=;#]|~{4}|__", text, re.MULTILINE):
        _wiki(text, nodes, literal)
    if re.search(r"[`*_|]|~~|\]\(|\[\^|^ {0,3}[#>\[-]|^={3}|\[[ xX]\]|<\w+:", text, re.MULTILINE):
        _markdown(text, nodes, literal)
    nodes.sort(key=lambda n: (n.start, -n.end))
    _constructs(text, nodes)
    whole: list[Node] = []
    at = 0
    for n in nodes:
        if n.start > at:
            whole.append(Node(at, n.start, None, "", PLAIN))
        whole.append(n)
        at = max(at, n.end)
    if at < len(text):
        whole.append(Node(at, len(text), None, "", PLAIN))
    edges: list[tuple[int, int, float]] = []
    last: dict[str, int] = {}
    under: dict[tuple[int, str], int] = {}
    for k, n in enumerate(whole):
        if k and (n.kind is None) != (whole[k - 1].kind is None):
            edges.append((k - 1, k, BESIDE_TEXT))
        if n.kind is None:
            continue
        j = last.get(n.kind)
        if j is not None:
            gap = text.count("\n", whole[j].end, n.start) if n.start > whole[j].end else 0
            if gap <= 1:
                edges.append((j, k, NEXT_LINE if gap else SAME_LINE))
        last[n.kind] = k
        if n.construct >= 0:
            j = under.get((n.construct, n.kind))
            if j is not None:
                edges.append((j, k, SAME_CONSTRUCT))
            under[n.construct, n.kind] = k
    if any(n.kind == "html" for n in whole):
        edges += _tree(text, whole, Spans(literal))
    return whole, min_cut([n.odds for n in whole], edges)


def convert(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, kinds of markup that occur) of a text; a null text stays null and has no kinds."""
    if text is None:
        return None, []
    nodes, residue = label(text)
    if not any(residue):
        return text, []
    kinds = {n.kind for n, r in zip(nodes, residue, strict=True) if r and n.kind}
    out: list[str] = []
    at = 0
    for n, r in zip(nodes, residue, strict=True):
        if n.start < at:
            if n.end <= at:
                continue  # inside a construct that was rendered or dropped whole
            if n.kind is not None:
                continue
        out.append(n.mark if r else text[max(at, n.start) : n.end])
        at = max(at, n.end)
    if any(r and n.kind is None for n, r in zip(nodes, residue, strict=True)):
        out = re.sub(r"(?m)^-[ \t]*$", "", "".join(out))  # items whose text went
    clean = re.sub(r"[ \t]+(?=\n)", "", "".join(out).replace("\r\n", "\n"))
    return re.sub(r"\n{3,}", "\n\n", clean).strip(), sorted(kinds)


def clean_markup(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, ``clean`` (text with residue converted) and ``kinds`` (sorted markup kinds that occur) of every row.

    Runs in the rows' own partitions, no shuffle. Defined cases: a null text gives null and no kinds, an empty text
    itself; a text without markup comes back unchanged; texts of any length are read whole; repeated rows and null
    keys are kept; an empty table gives no rows; extra columns are dropped.
    """
    kept = [df.schema[k] for k in keys]
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [convert(t) for t in batch.column(len(names)).to_pylist()]
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))], names=[*names, "clean", "kinds"])

    slim = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(text).alias("text"))
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept, strict=True))
    return slim.mapInArrow(run, f"{schema}, clean string, kinds array<string>").withColumnsRenamed(dict(zip(names, keys, strict=True)))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "wikipedia_link", "id", "content").select(F.lit("wikipedia_link").alias("src"), F.col("id").alias("rec_id"), F.col("content").alias("body"))
    articles = table(spark, sf_dir, "count_word", "rec_no", "body").select(F.lit("count_word").alias("src"), F.col("rec_no").alias("rec_id"), "body")
    return pages.unionByName(articles)


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rec_id and the clean text of every record; a page stored twice has two rows only if its contents differ."""
    return clean_markup(_records(spark, sf_dir), ["src", "rec_id"], "body").select("src", "rec_id", "clean").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each kind of markup that occurs in a record's text."""
    return clean_markup(_records(spark, sf_dir), ["src", "rec_id"], "body").select("src", "rec_id", F.explode("kinds").alias("markup")).distinct()


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean}
ORACLES: dict[str, str] = {}
