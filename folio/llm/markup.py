"""Markup residue: HTML, Markdown, wiki text and LaTeX to clean text, with a site style tree per host.

A record's text is parsed into a tree: HTML elements nest, and every other construct that one of the four languages would render
or hide is a node under the elements that hold it. A record holds markup if its tree has a node. The trees of a host (a
collection) are merged: of every path the style tree knows in how many records it stands, with which content and with which
children. The importance of a leaf's content is 1 - log(n) / log(m), the entropy of a content that n of the m records with this
path share evenly; that of a presentation node is the entropy of its presentations, to base m, and never less than that of what
stands below its path. Branches whose importance is under LEAST, on paths with at least SITE records, are removed from each page
with all they hold: presentation nodes by their path, contents by path and content. Headings, lists, code, formulas, emphasis and
table marks are nodes but no branches of their own, so that meaningful structure stays whatever repeats; what remains is written as clean
text, in which headings, lists, code blocks, formulas and the order of cells stay.

Null and empty texts have no constructs and null or empty clean text. Rows that repeat a key are one record. Null cells are empty
cells; ragged rows stay ragged.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folio.session import materialize

LEAST, SITE = 0.2, 4

# Element names of HTML, and commands of LaTeX that stand without arguments.
ELEMENTS = (
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn "
    "dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label "
    "legend li link main map mark meta meter nav noscript object ol optgroup option output p param picture pre progress q ref references nowiki rp rt ruby s samp script section select small "
    "source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr math"
).split()
BARE = (
    "item hline toprule midrule bottomrule centering maketitle tableofcontents newpage clearpage noindent par bigskip medskip smallskip ldots dots LaTeX TeX "
    "alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega "
    "cdot times le leq ge geq ne neq approx equiv sim pm infty sum prod int partial nabla rightarrow leftarrow Rightarrow to in forall exists quad qquad left right bf it em tt rm sc"
).split()

#: What commands of LaTeX stand for in running text; Greek letters follow from their names. Fixed values.
SIGNS = {
    "cdot": "·", "times": "×", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "pm": "±", "infty": "∞", "sum": "∑", "prod": "∏", "int": "∫",
    "partial": "∂", "nabla": "∇", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "to": "→", "in": "∈", "forall": "∀", "exists": "∃", "ldots": "…", "dots": "…", "quad": " ", "qquad": "  ", "LaTeX": "LaTeX", "TeX": "TeX",
}


def _sign(m: re.Match) -> str:
    name = m[1]
    greek = f"GREEK {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {'LAMDA' if name.lower() == 'lambda' else name.removeprefix('var').upper()}"
    try:
        return SIGNS[name] if name in SIGNS else unicodedata.lookup(greek)
    except KeyError:
        return ""


_VOID = {"br", "hr", "img", "input", "meta", "link", "col", "wbr", "area", "base", "embed", "param", "source", "track"}
_NAMED = frozenset(ELEMENTS) - _VOID
_NAMES = "|".join(sorted(ELEMENTS, key=len, reverse=True))
TAG = re.compile(rf"<(/?)({_NAMES})(?=[\s/>])((?:\s+[^<>]*)?)\s*(/?)>", re.I)
COMMENT = re.compile(r"<!--.*?-->|<!doctype\b[^<>]*>|<\?xml\b[^<>]*\?>|<!\[CDATA\[.*?\]\]>", re.I | re.S)
ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_PATH = r"(?<![:\w\\])"

#: (kind, pattern); where a pattern alone does not decide, _known() does.
PATTERNS: tuple[tuple[str, re.Pattern], ...] = (
    ("comment", COMMENT),
    ("tag", TAG),
    ("autolink", re.compile(r"<(?:https?://|mailto:)[^\s<>]+>")),
    ("entity", ENTITY),
    ("fence", re.compile(r"^[ ]{0,3}(```+|~~~+)[^\n`]*$", re.M)),
    ("code", re.compile(r"(?<![`\\])(`{1,2})(?!`)[^`\n]+?(?<!`)\1(?!`)")),
    ("md_heading", re.compile(r"^ {0,3}#{1,6}[ \t]+[^\s#]", re.M)),
    ("setext", re.compile(r"^[^\s|][^\n]*\r?\n(?:={3,}|-{3,})[ \t]*$", re.M)),
    ("rule", re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)),
    ("strong", re.compile(r"(?<![*\w\\])\*{2,3}(?=[^\s*])[^*\n]*(?:\n[^*\n]+){0,3}(?<=[^\s*])\*{2,3}(?![*\w])|(?<![\w_\\])__(?=[^\s_])(?:[^_\n]|(?<=\w)_(?=\w))+(?<=[^\s_])__(?![\w_])")),
    ("emphasis", re.compile(r"(?<![*\w\\])\*(?=[^\s*])[^*\n]*(?<=[^\s*\\])\*(?![*\w])|(?<![\w_\\/])_(?=[^\s_])(?:[^_\n]|(?<=\w)_(?=\w))+(?<=[^\s_])_(?![\w_])")),
    ("strike", re.compile(r"~~(?=[^\s~])[^~\n]+(?<=\S)~~")),
    ("link", re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+\"[^\"\n]*\")?\)")),
    ("reference", re.compile(r"!?\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^ {0,3}\[[^\[\]\n]+\]:[ \t]+\S+|\[\^[^\[\]\s]+\]", re.M)),
    ("quote", re.compile(r"^ {0,3}>[ \t]?\S", re.M)),
    ("task", re.compile(r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]", re.M)),
    ("bullet", re.compile(r"^[ \t]*[*+][ \t]+\S", re.M)),
    ("md_table", re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", re.M)),
    ("wiki_heading", re.compile(r"^={2,6}[ \t]*[^=\s][^=\n]*?={2,6}[ \t]*$", re.M)),
    ("wiki_quote", re.compile(r"(?<!')('{2,3}|'{5})(?=[^\s'])[^'\n]*(?:(?<=\w)'(?=\w)[^'\n]*)*(?<=[^\s'])\1(?!')")),
    ("wiki_link", re.compile(r"\[\[[^\[\]\n]+(?:\[\[[^\[\]\n]*\]\][^\[\]\n]*)*\]\]|\[https?://[^\s\[\]]+(?:\s[^\[\]\n]*)?\]")),
    ("template", re.compile(r"\{\{[^{}]+(?:\{\{[^{}]*\}\}[^{}]*)*\}\}")),
    ("wiki_table", re.compile(r"^[ \t]*(?:\{\||\|\}|\|-)", re.M)),
    ("wiki_word", re.compile(r"__(?:NO)?TOC__|__NOEDITSECTION__|~{3,5}(?!~)(?<=[\w. ]~~~)")),
    ("environment", re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}")),
    ("command", re.compile(_PATH + r"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?\{")),
    ("bare", re.compile(_PATH + rf"\\(?:{'|'.join(sorted(BARE, key=len, reverse=True))})(?![A-Za-z\\])")),
    ("row_end", re.compile(r"(?<=[^\\\n])[ \t]\\\\[ \t]*(?=\r?\n|$)")),
    ("escape", re.compile(r"(?<![\\\w:])\\[#$%&_{}](?![\\])")),
    ("display", re.compile(r"\$\$[^$]+\$\$|\\\[.+?\\\]|\\\(.+?\\\)", re.S)),
    ("math", re.compile(r"(?<![\\$\w])\$(?=[^\s$\d])[^$\n]*?(?<=[^\s\\$])\$(?![\d$\w])|(?<![\\$\w])\$(?=\d)[^$\n]*?[\\^_=][^$\n]*?(?<=[^\s\\$])\$(?![\d$\w])")),
)

#: A superset of what PATTERNS can match, for the JVM: texts without it never reach Python.
MAYBE = (
    r"<[!?/a-zA-Z]|&[#a-zA-Z][0-9a-zA-Z]*;|`|\*\S|__|~~|\]\(|\]\[|\]:|\[\^|\[\[|\{\{|\{\||''|\\[A-Za-z#$%&_{}\[(\\]|\$[^$\n]+\$|\$\$|(?:^|\W)_\S"
    r"|(?m:^[ \t]*(?:#{1,6}[ \t]|>|[*+][ \t]|[-*_=]{3,}|-[ \t]*-|_[ \t]*_|\*[ \t]*\*|\|[-}]|[-*+][ \t]+\[[ xX]\]|={2,}|\|?[ \t]*:?-{3,})|\[https?:)"
)


def maybe_markup(text: Column) -> Column:
    return text.rlike(MAYBE)


def _known(kind: str, m: re.Match) -> bool:
    if kind == "entity":
        name = m.group(1)
        return name[0] == "#" or name + ";" in html5
    if kind == "setext":
        return not m.group(0).lstrip().startswith(("|", "{|"))
    return True


def constructs(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every construct, in order."""
    if not text:
        return []
    found = [(kind, *m.span()) for kind, p in PATTERNS for m in p.finditer(text) if _known(kind, m)]
    found.sort(key=lambda x: (x[1], -x[2]))
    return found


def has_markup(text: str | None) -> bool:
    return bool(text) and any(_known(kind, m) for kind, p in PATTERNS for m in p.finditer(text))


def _digest(s: str) -> str:
    return hashlib.blake2b(" ".join(s.split()).lower().encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


#: Constructs that are branches of a page: what a host may repeat on every page and that nobody misses.
BRANCHES = ("=comment", "=template", "=wiki_link", "=reference", "=link")


def nodes(text: str | None, found: list[tuple[str, int, int]] | None = None) -> list[tuple[str, str, bool, int, int]]:
    """(path, content, leaf, start, end) of the nodes of the text's tree, one or more for every construct.

    Elements go by their names, other constructs by '=' and their kind. content is a digest: of a leaf's text, of a presentation
    node's sequence of children.
    """
    if not text:
        return []
    out, stack = [], []
    last = 0
    for kind, start, end in constructs(text) if found is None else found:
        if kind != "tag":
            if start < last:
                continue
            name = f"={kind}"
            out.append(("/".join([*(s[0] for s in stack), name]), _digest(text[start:end]), True, start, end))
            if stack:
                stack[-1][2].append(name)
            last = end
            continue
        m = TAG.match(text, start)
        name = m.group(2).lower()
        alone = name in _VOID or bool(m.group(4))
        if m.group(1):
            if any(s[0] == name for s in stack):
                while stack:
                    tag, begun, children = stack.pop()
                    out.append(_element(text, stack, tag, children, begun, end if tag == name else start))
                    if tag == name:
                        break
                continue
            alone = True
        if stack:
            stack[-1][2].append(name)
        if alone:
            out.append(("/".join([*(s[0] for s in stack), name]), _digest(m.group(0)), True, start, start))
        else:
            stack.append((name, start, []))
    while stack:
        tag, begun, children = stack.pop()
        out.append(_element(text, stack, tag, children, begun, len(text)))
    return out


def _element(text, stack, tag, children, start, end):
    branches = [c for c in children if c in BRANCHES or c in _NAMED]
    return "/".join([*(s[0] for s in stack), tag]), _digest(" ".join(children)) if branches else _digest(text[start:end]), not branches, start, end


_HEAD = {"section": "#", "chapter": "#", "subsection": "##", "subsubsection": "###", "paragraph": "####", "title": "#"}
_BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "main", "aside", "table", "tbody", "thead", "ul", "ol", "dl", "blockquote", "pre", "figure", "form", "address", "body", "html", "hr", "br"}


def _tag_text(m: re.Match) -> str:
    name, closing = m.group(2).lower(), bool(m.group(1))
    if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return "\n" if closing else "\n" + "#" * int(name[1]) + " "
    if name == "li":
        return "" if closing else "\n- "
    if name == "tr":
        return "\n" if closing else ""
    if name in ("td", "th"):
        return " | " if closing else ""
    return "\n" if name in _BLOCK else ""


def clean(text: str | None, drop: frozenset[tuple[str, str]] = frozenset()) -> str | None:
    """Clean text; nodes whose path and content are in drop, or whose path is with an empty content, are removed with all they hold."""
    if not text:
        return text
    if drop:
        gone = sorted((a, b) for p, c, _, a, b in nodes(text) if (p, c) in drop or (p, "") in drop)
        out, at = [], 0
        for a, b in gone:
            if a >= at:
                out.append(text[at:a])
            at = max(at, b)
        text = "".join([*out, text[at:]])
    held: list[str] = []

    def keep(s: str) -> str:
        held.append(s)
        return f"\ue000{len(held) - 1}\ue001"

    t = text.replace("\r\n", "\n")
    t = re.sub(r"<(script|style)\b[^<>]*>.*?</\1\s*>", "", t, flags=re.I | re.S)
    t = COMMENT.sub("", t)
    t = re.sub(r"<ref\b[^<>]*(?:/>|>.*?</ref\s*>)", "", t, flags=re.I | re.S)
    t = re.sub(r"<nowiki\b[^<>]*>(.*?)</nowiki\s*>", lambda m: keep(m[1]), t, flags=re.I | re.S)
    t = re.sub(r"<ol\b[^<>]*>(?:(?!<[ou]l\b).)*?</ol\s*>", _numbered, t, flags=re.I | re.S)
    t = re.sub(r"\\begin\{enumerate\}.*?\\end\{enumerate\}", lambda m: _count(r"\\item(?![A-Za-z\[])[ \t]*", m[0], "{}. "), t, flags=re.S)
    t = re.sub(r"^ {0,3}(```+|~~~+)([^\n`]*)\n(.*?)\n {0,3}\1[ \t]*$", lambda m: keep(f"```{m[2].strip()}\n{m[3]}\n```"), t, flags=re.M | re.S)
    t = re.sub(r"<pre\b[^<>]*>(?:\s*<code\b[^<>]*>)?(.*?)(?:</code>\s*)?</pre\s*>", lambda m: "\n" + keep(f"```\n{html.unescape(m[1]).strip(chr(10))}\n```") + "\n", t, flags=re.I | re.S)
    t = re.sub(r"\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", lambda m: keep(f"```\n{m[2].strip(chr(10))}\n```"), t, flags=re.S)
    t = re.sub(r"\\begin\{(equation|align|gather|displaymath|math|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}", lambda m: keep(f"$${m[3].strip()}$$"), t, flags=re.S)
    t = re.sub(r"\$\$([^$]+)\$\$|\\\[(.+?)\\\]", lambda m: keep(f"$${(m[1] or m[2]).strip()}$$"), t, flags=re.S)
    t = re.sub(r"\\\((.+?)\\\)", lambda m: keep(f"${m[1].strip()}$"), t, flags=re.S)
    t = PATTERNS_BY["math"].sub(lambda m: keep(m[0]), t)
    t = PATTERNS_BY["code"].sub(lambda m: keep(m[0].strip("`").strip()), t)
    t = re.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría|Категория|分类|カテゴリ)\s*:[^\[\]]*\]\]", "", t, flags=re.I)
    t = re.sub(r"\[\[(?:File|Image|Datei|Fichier|Archivo|Файл|文件|ファイル)\s*:(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", lambda m: "" if "|" not in m[0] else m[1], t, flags=re.I)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", t)
    for _ in range(3):
        t = re.sub(r"\{\{([^{}|]*)((?:\|[^{}]*)?)\}\}", lambda m: "; ".join(p.strip().replace("=", ": ", 1) for p in m[2].split("|")[1:]), t)
    t = re.sub(r"^[ \t]*\{\|[^\n]*\n?|^[ \t]*\|\}[ \t]*|^[ \t]*\|-[^\n]*\n?", "", t, flags=re.M)
    t = re.sub(r"^[ \t]*!\s*([^\n]*)$", lambda m: m[1].replace("!!", "|") if "!!" in m[1] else m[0], t, flags=re.M)
    t = re.sub(r"^([ \t]*)\|([^|\n][^\n]*)$", lambda m: m[2].strip().strip("|").replace("||", "|").strip(), t, flags=re.M)
    t = PATTERNS_BY["md_table"].sub("", t)
    t = re.sub(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", lambda m: "#" * (len(m[1]) - 1) + " " + m[2], t, flags=re.M)
    t = re.sub(r"^([^\s|][^\n]*)\n(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], t, flags=re.M)
    t = re.sub(r"'{5}([^'\n]+)'{5}|'{3}([^'\n]+)'{3}|(?<!')''([^'\n]+)''(?!')", lambda m: m[1] or m[2] or m[3], t)
    t = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+\"[^\"\n]*\")?\)", r"\1", t)
    t = re.sub(r"^ {0,3}\[[^\[\]\n]+\]:[ \t]+\S+[^\n]*\n?|\[\^[^\[\]\s]+\]", "", t, flags=re.M)
    t = re.sub(r"!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", t)
    t = re.sub(r"\[https?://[^\s\[\]]+\s*([^\[\]\n]*)\]", r"\1", t)
    t = re.sub(r"<((?:https?://|mailto:)[^\s<>]+)>", r"\1", t)
    t = re.sub(r"^ {0,3}>[ \t]?", "", t, flags=re.M)
    for kind, n in (("strong", 2), ("emphasis", 1), ("strike", 2)):
        t = PATTERNS_BY[kind].sub(lambda m: m[0].strip("*_~" if len(m[0].strip("*_~")) else ""), t)
    t = re.sub(r"\{\\(?:bf|it|em|tt|rm|sc)\s+([^{}]*)\}", r"\1", t)
    for _ in range(3):
        t = re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", lambda m: "/".join(x if re.fullmatch(r"\w+", x) else f"({x})" for x in (m[1], m[2])), t)
    t = re.sub(r"\\((?:sub)*section|chapter|paragraph|title)\*?\{([^{}]*)\}", lambda m: f"{_HEAD.get(m[1], '#')} {m[2]}", t)
    t = re.sub(r"[ \t]*\\\\[ \t]*(?=\n|$)", "", t)
    t = re.sub(r"(?m)^([^\n]*?) & ([^\n]*)$", lambda m: m[0].replace(" & ", " | ") if "tabular" in text else m[0], t)
    t = re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\[\]]*\]|\{[^{}]*\})*[ \t]*\n?", "", t)
    t = re.sub(r"\\item(?:\[([^\[\]]*)\])?[ \t]*", lambda m: "- " + (m[1] + " " if m[1] else ""), t)
    t = re.sub(r"[~ ]?\\(?:label|cite[a-z]*|ref|eqref|pageref|index|vspace|hspace|usepackage|documentclass)\*?(?:\[[^\[\]]*\])*\{[^{}]*\}", "", t)
    for _ in range(3):
        t = re.sub(_PATH + r"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])*\{([^{}]*)\}", r"\1", t)
    t = re.sub(_PATH + rf"\\({'|'.join(sorted(BARE, key=len, reverse=True))})(?![A-Za-z\\])([ ]?)", lambda m: (x + m[2] if (x := _sign(m)) else ""), t)
    t = re.sub(r"(?<![\\\w:])\\([#$%&_{}])", r"\1", t)
    t = TAG.sub(_tag_text, t)
    t = ENTITY.sub(lambda m: html.unescape(m[0]), t).replace("\xa0", " ")
    t = re.sub(r" \|\s*(?=\n|$)", "", t)
    t = re.sub(r"[ \t]+(?=\n)|[ \t]+$", "", re.sub(r"(?<=\S)[ \t]{2,}", " ", t))
    t = re.sub(r"\n{3,}", "\n\n", t).strip("\n")
    return re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m[1])], t)


PATTERNS_BY = dict(PATTERNS)


def _count(item: str, text: str, form: str) -> str:
    """The text with each item's mark as its number in the given form."""
    numbers = iter(range(1, len(text)))
    return re.sub(item, lambda m: form.format(next(numbers)), text, flags=re.I)


def _numbered(m: re.Match) -> str:
    """An ordered list without lists in it, its items numbered."""
    return _count(r"<li\b[^<>]*>\s*", m[0], "\n{}. ")


def records(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """(origin, record_key, host, rows): both tables as records of rows of cells; a chunk is one cell."""
    chunk = chunks.filter(F.col("text").isNotNull() & F.col("chunk_id").isNotNull()).select(F.lit("chunk").alias("origin"), F.col("chunk_id").alias("record_key"), F.coalesce("collection", F.lit("")).alias("host"), F.array(F.array("text")).alias("rows"))
    key = F.concat("doc", F.lit("#"), F.col("page").cast("string"), F.lit("#"), F.col("table_no").cast("string"))
    cells = tables.filter(F.col("rows").isNotNull()).select(F.lit("page_table").alias("origin"), key.alias("record_key"), F.substring_index("doc", "/", 1).alias("host"), "rows")
    return chunk.unionByName(cells.filter(F.col("record_key").isNotNull()))


def _texts(rows: Column) -> Column:
    return F.filter(F.flatten(F.filter(rows, lambda r: r.isNotNull())), lambda c: c.isNotNull())


def candidates(rows: DataFrame) -> DataFrame:
    return rows.filter(F.exists(_texts(F.col("rows")), maybe_markup))


TREE = "origin string, record_key string, host string, constructs int, nodes array<struct<path:string,content:string,leaf:boolean>>"


def _parse(batches, keep: bool):
    for batch in batches:
        out = {"constructs": [], "nodes": []}
        for rows in batch.column(3).to_pylist():
            cells = [c for r in rows if r for c in r if c]
            tree = [x for c in cells for x in nodes(c)]
            out["constructs"].append(len(tree))
            out["nodes"].append([{"path": p, "content": c, "leaf": leaf} for p, c, leaf, _, _ in tree])
        kind = pa.list_(pa.struct([("path", pa.string()), ("content", pa.string()), ("leaf", pa.bool_())]))
        held = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out["constructs"], pa.int32()), pa.array(out["nodes"], kind)], ["origin", "record_key", "host", "constructs", "nodes"])
        if keep:
            held = held.append_column("rows", batch.column(3))
        yield held.filter(pa.array([n > 0 for n in out["constructs"]], pa.bool_()))


def trees(rows: DataFrame, keep: bool = False) -> DataFrame:
    """TREE of each record that holds a construct, with its rows if they are to be kept; copies of a record once."""
    schema = f"{TREE}, rows array<array<string>>" if keep else TREE
    return candidates(rows).select("origin", "record_key", "host", "rows").mapInArrow(lambda it: _parse(it, keep), schema).dropDuplicates(["origin", "record_key"])


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, path, content, leaf, n, m, importance, branch): the merged trees of each host.

    importance is that of a leaf's content or of a presentation node, branch the greatest on the path and below it.
    """
    flat = parsed.select("host", F.concat_ws("\0", "origin", "record_key").alias("r"), F.explode("nodes").alias("x")).select("host", "r", "x.*").distinct()
    shared = flat.groupBy("host", "path", "content", "leaf").agg(F.count("*").alias("n"))
    # m records have the path; as one may hold several contents of it, presentations are weighed by the sum of theirs.
    m = shared.groupBy("host", "path", "leaf").agg(F.sum("n").alias("sum"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"), F.min("n").alias("least"))
    m = m.join(flat.groupBy("host", "path", "leaf").agg(F.count_distinct("r").alias("m")), ["host", "path", "leaf"])
    leaf = lambda n: 1 - F.try_divide(F.ln(n), F.ln("m"))
    inner = F.least(F.lit(1.0), F.try_divide(F.ln("sum") - F.col("nlogn") / F.col("sum"), F.ln("m")))
    weigh = lambda n: F.when(F.col("m") <= 1, F.lit(1.0)).when(F.col("leaf"), leaf(n)).otherwise(inner)
    # Of a path the rarest content weighs most; every path above it weighs no less.
    names = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), "/"))
    branch = m.select("host", F.explode(above).alias("path"), weigh("least").alias("w")).groupBy("host", "path").agg(F.max("w").alias("branch"))
    return shared.join(m, ["host", "path", "leaf"]).withColumn("importance", weigh("n")).drop("nlogn", "least", "sum").join(branch, ["host", "path"])


def _clean(batches):
    for batch in batches:
        texts = []
        for rows, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            gone = frozenset((d["path"], d["content"]) for d in drop or ())
            if len(rows) == 1 and rows[0] and len(rows[0]) == 1:
                texts.append(clean(rows[0][0], gone))
            else:
                texts.append("\n".join(" | ".join((clean(c, gone) or "").replace("\n", " ") for c in r or ()) for r in rows))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(d or ()) for d in batch.column(3).to_pylist()], pa.int32())], ["origin", "record_key", "text", "dropped"])


def cleaned(rows: DataFrame) -> DataFrame:
    """(origin, record_key, text, dropped): clean text of each record with markup; dropped counts the branches and contents that the
    style tree removes. A removed presentation node goes by its path, with an empty content; a leaf by path and content."""
    parsed = materialize(trees(rows, keep=True), "trees")
    removable = F.element_at(F.split("path", "/"), -1).isin(*BRANCHES, *sorted(_NAMED))
    tree = style_tree(parsed).filter((F.col("m") >= SITE) & removable)
    low = tree.filter(F.when(F.col("leaf"), F.col("importance") < LEAST).otherwise(F.col("branch") < LEAST))
    low = low.select("host", "path", "content", F.when(F.col("leaf"), F.col("content")).otherwise("").alias("gone"))
    used = parsed.select("origin", "record_key", "host", F.explode("nodes").alias("x")).select("origin", "record_key", "host", "x.path", "x.content")
    drops = used.join(low, ["host", "path", "content"]).groupBy("origin", "record_key").agg(F.collect_set(F.struct("path", F.col("gone").alias("content"))).alias("drop"))
    source = parsed.select("origin", "record_key", "rows").join(drops, ["origin", "record_key"], "left")
    return source.select("origin", "record_key", "rows", "drop").mapInArrow(_clean, "origin string, record_key string, text string, dropped int")
