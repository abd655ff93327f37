"""HTML to Markdown and HTML tables to rows, with a tag scanner of the standard library."""

from __future__ import annotations

from html.parser import HTMLParser

_SKIP = {"script", "style", "head", "template", "noscript"}
_BREAK = {"p", "div", "section", "article", "header", "footer", "ul", "ol", "blockquote", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table"}


def _span(attrs, name: str) -> int:
    value = dict(attrs).get(name) or "1"
    return min(1000, int(value)) if value.isdigit() and int(value) > 0 else 1


class Tables(HTMLParser):
    """Every table of a text: cells as (text, rowspan, colspan, header) per row, and where it stands."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.done: list[dict] = []
        self.lines = [0]
        for line in text.splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))
        self.feed(text)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"start": self._at(), "rows": [], "cell": None, "depth": len(self.open)})
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                t["rows"].append([])
                t["cell"] = None
            elif tag in ("td", "th"):
                if not t["rows"]:
                    t["rows"].append([])
                t["cell"] = ["", _span(attrs, "rowspan"), _span(attrs, "colspan"), tag == "th"]
                t["rows"][-1].append(t["cell"])
            elif tag == "br" and t["cell"] is not None:
                t["cell"][0] += " "

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            t = self.open.pop()
            t["end"] = self._at() + len("</table>")
            self.done.append(t)
        elif tag in ("td", "th") and self.open:
            self.open[-1]["cell"] = None

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"][0] += data


def grid(cells: list[list[list]]) -> tuple[list[list[str]], int]:
    """Rectangular rows, and the number of leading header rows; a merged cell's text stands at its first place, its others are empty."""
    rows: list[dict[int, str]] = [{} for _ in cells]
    heads = 0
    for r, row in enumerate(cells):
        c = 0
        for text, down, across, _ in row:
            while c in rows[r]:
                c += 1
            for i in range(r, min(len(rows), r + down)):
                for j in range(c, c + across):
                    rows[i].setdefault(j, " ".join(text.split()) if (i, j) == (r, c) else "")
            c += across
        if heads == r and row and all(cell[3] for cell in row):
            heads += 1
    width = max((max(r) + 1 for r in rows if r), default=0)
    return [[r.get(c, "") for c in range(width)] for r in rows], heads


def html_tables(text: str) -> list[tuple[int, int, list[list[str]], int]]:
    """(start, end, rows, header rows) of the outermost tables; of nested ones the largest stands for all."""
    found = [(t["start"], t["end"], *grid(t["rows"])) for t in Tables(text).done if t["rows"]]
    outer: list[list] = []
    for t in sorted(found, key=lambda t: (t[0], -t[1])):
        if outer and t[1] <= outer[-1][1]:
            best = outer[-1]
            if sum(map(len, t[2])) > sum(map(len, best[2])):
                best[2], best[3] = t[2], t[3]
        else:
            outer.append(list(t))
    return [tuple(t) for t in outer]


def to_pipes(rows: list[list[str]], heads: int = 1) -> str:
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in rows]
    k = max(1, heads)
    return "\n".join([*lines[:k], "|" + "---|" * (len(rows[0]) if rows else 0), *lines[k:]])


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.pre = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + mark)
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag in _BREAK:
            self.out.append("\n" if tag == "br" else "\n\n")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n\n")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in _BREAK:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else data if data.strip() == "" and "\n" not in data else " ".join(data.split(" ")).replace("\n", " "))


def html_to_markdown(text: str) -> str:
    """Headings, lists, code, bold and tables as Markdown; scripts and styles dropped; idempotent on its own output's text."""
    import re

    parts, at = [], 0
    for start, end, rows, heads in html_tables(text):
        parts += [_plain(text[at:start]), "\n\n" + to_pipes(rows, heads) + "\n\n"]
        at = end
    parts.append(_plain(text[at:]))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(parts))).strip()


def _plain(text: str) -> str:
    p = _Markdown()
    p.feed(text)
    p.close()
    return "".join(p.out)
