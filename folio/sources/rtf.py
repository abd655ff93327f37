"""RTF to Markdown: a lexer over groups, control words and code pages; tables become pipe rows."""

from __future__ import annotations

import re

TOKEN = re.compile(rb"\\([a-zA-Z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
#: Groups without text of the document, and control words that stand for text. Fixed values.
SKIPPED = {b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"header", b"footer", b"headerf", b"footerf", b"object", b"themedata", b"listtable", b"listoverridetable", b"generator", b"fldinst", b"datastore"}
SIGNS = {b"par": "\n\n", b"line": "\n", b"tab": "\t", b"emdash": "—", b"endash": "–", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”", b"bullet": "•", b"cell": "\x1f", b"row": "\x1e", b"page": "\n\n", b"sect": "\n\n"}
CODEPAGES = {437: "cp437", 850: "cp850", 932: "cp932", 936: "gbk", 949: "cp949", 950: "big5", 65001: "utf-8"}


def rtf_to_markdown(data: bytes) -> str:
    """The text of an RTF file; what is no RTF is decoded as it is."""
    if not data.lstrip().startswith(b"{\\rtf"):
        return data.decode("utf-8", "replace")
    out: list[str] = []
    pending = bytearray()
    page, skip, drop, stack = "cp1252", False, 0, []
    fallback = 1

    def flush() -> None:
        if pending:
            out.append(bytes(pending).decode(page, "replace"))
            pending.clear()

    first = False
    for m in TOKEN.finditer(data):
        word, number, code, sign, brace, text = m.groups()
        if brace == b"{":
            flush()
            stack.append((skip, fallback))
            first = True
            continue
        if brace == b"}":
            flush()
            skip, fallback = stack.pop() if stack else (False, 1)
            continue
        if sign == b"*" and first:
            skip = True
        elif word:
            if word in SKIPPED:
                skip = True
            elif word == b"ansicpg" and number:
                n = int(number)
                page = CODEPAGES.get(n, f"cp{n}" if 1250 <= n <= 1258 or n == 874 else "cp1252")
            elif word == b"uc":
                fallback = int(number or 1)
            elif word == b"u" and number and not skip:
                flush()
                out.append(chr(int(number) % 65536))
                drop = fallback
            elif word in SIGNS and not skip:
                flush()
                out.append(SIGNS[word])
        elif code and not skip:
            if drop:
                drop -= 1
            else:
                pending.append(int(code, 16))
        elif sign and not skip:
            flush()
            out.append({b"~": "\u00a0", b"_": "‑", b"-": "\u00ad"}.get(sign, sign.decode("latin-1") if sign in b"\\{}" else ""))
        elif text and not skip:
            piece = text[drop:] if drop else text
            drop = max(0, drop - len(text))
            pending.extend(piece)
        if m.lastindex is not None or word:
            first = False
    flush()
    whole = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    lines: list[str] = []
    rows: list[list[str]] = []
    for part in re.split("(\x1e)", whole):
        if part == "\x1e":
            continue
        if "\x1f" in part:
            head, *cells = part.split("\x1f")
            before, _, cell = head.rpartition("\n\n")
            if before.strip():
                lines += _table(rows) + [before.strip()]
                rows = []
            rows.append([c.strip().replace("\n", " ").replace("|", "\\|") for c in [cell, *cells[:-1]]])
        else:
            lines += _table(rows)
            rows = []
            lines.append(part)
    lines += _table(rows)
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(x.strip("\n") for x in lines if x.strip())).strip()


def _table(rows: list[list[str]]) -> list[str]:
    if not rows:
        return []
    width = max(map(len, rows))
    text = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return ["\n".join([text[0], "|" + "---|" * width, *text[1:]])]
