"""The block structure of Markdown: which lines are headings, which are code.

A fold over the lines of a file with a stack of open containers (quotes, and list
items by their indent) and one open leaf (paragraph, fence, HTML block).  Headings
inside a container are no headings of the document; lines of code and of HTML
blocks hold no text.  A file is one row of an Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
BREAK = re.compile(r"([-*_])[ \t]*(?:\1[ \t]*){2,}$")
FENCE = re.compile(r"(`{3,}|~{3,})(.*)$")
ITEM = re.compile(r"([-+*]|([0-9]{1,9})[.)])([ \t]+|$)")
# Names of tags that begin an HTML block.
_TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
_ATTRIBUTE = r"\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?"
#: How an HTML block begins, how it ends (None: before a blank line), and whether
#: it may follow a line of a paragraph.
HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r"<!--"), re.compile(r"-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(r"<![A-Za-z]"), re.compile(r">"), True),
    (re.compile(rf"</?(?:{'|'.join(_TAGS.split())})(?:\s|/?>|$)", re.I), None, True),
    (re.compile(rf"(?:<[A-Za-z][\w-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$"), None, False),
]


def _indent(s: str) -> int:
    return len(s) - len(s.lstrip(" "))


def structure(lines: list[str]) -> list[tuple[bool, int | None, str | None]]:
    """(code, level, title) of each line; level and title where a heading of the
    document starts."""
    out: list[list] = [[False, None, None] for _ in lines]
    stack: list[int] = []  # 0 a quote, else the indent of a list item
    paragraph: list[int] = []  # its lines, if one is open
    fence: tuple[str, int] | None = None
    html: tuple | None = None
    for i, raw in enumerate(lines):
        head = raw[: len(raw) - len(raw.lstrip(" \t"))]
        s = head.expandtabs(4) + raw[len(head) :] if "\t" in head else raw
        held = 0
        for width in stack:
            if width == 0 and _indent(s) < 4 and s.lstrip(" ").startswith(">"):
                s = s.lstrip(" ")[1:]
                s = s[1:] if s.startswith(" ") else s
            elif width and (not s.strip() or _indent(s) >= width):
                s = s[width:]
            else:
                break
            held += 1
        if held < len(stack):
            lazy = paragraph and s.strip() and not fence and not html and not _begins(s, True) and not BREAK.match(s.strip())
            if lazy:
                paragraph.append(i)
                continue
            stack, paragraph, fence, html = stack[:held], [], None, None
        blank = not s.strip()
        if fence:
            out[i][0] = True
            m = FENCE.match(s.strip()) if _indent(s) < 4 else None
            if m and m[1][0] == fence[0] and len(m[1]) >= fence[1] and not m[2].strip():
                fence = None
            continue
        if html:
            if html[0] is None and blank:
                html = None
            else:
                out[i][0] = True
                html = None if html[0] is not None and html[0].search(s) else html
            continue
        if blank:
            paragraph = []
            continue
        while True:
            t, wide = s.lstrip(" "), _indent(s) >= 4
            if wide:
                if paragraph:
                    paragraph.append(i)
                else:
                    out[i][0] = True
                break
            if t.startswith(">"):
                stack, paragraph = [*stack, 0], []
                s = t[2:] if t[1:2] == " " else t[1:]
                if not s.strip():
                    break
                continue
            if m := ATX.match(t):
                if not stack:
                    out[i][1:] = [len(m[1]), m[2] or ""]
                paragraph = []
                break
            m = FENCE.match(t)
            if m and (m[1][0] == "~" or "`" not in m[2]):
                fence, paragraph = (m[1][0], len(m[1])), []
                out[i][0] = True
                break
            kind = next((k for k in HTML if k[0].match(t) and (k[2] or not paragraph)), None)
            if kind:
                out[i][0], paragraph = True, []
                html = None if kind[1] is not None and kind[1].search(t) else (kind[1],)
                break
            if paragraph and (m := UNDERLINE.match(t)):
                if not stack:
                    out[paragraph[0]][1:] = [1 if m[1][0] == "=" else 2, " ".join(lines[k].strip() for k in paragraph)]
                paragraph = []
                break
            if BREAK.match(t):
                paragraph = []
                break
            m = ITEM.match(t)
            if m and not (paragraph and (not t[m.end() :].strip() or m[2] not in (None, "1"))):
                gap = len(m[3].expandtabs(4))
                body = t[m.end() :]
                width = _indent(s) + len(m[1]) + (gap if 1 <= gap <= 4 and body.strip() else 1)
                stack, paragraph = [*stack, width], []
                s = " " * (gap - 1) + body if gap > 4 else body
                if not s.strip():
                    break
                continue
            paragraph.append(i)
            break
    return [tuple(x) for x in out]


def _begins(s: str, paragraph: bool) -> bool:
    """Whether a line begins a block that ends a paragraph."""
    if _indent(s) >= 4:
        return False
    t = s.lstrip(" ")
    m = ITEM.match(t)
    return bool(t.startswith(">") or ATX.match(t) or FENCE.match(t) or any(k[0].match(t) and k[2] for k in HTML) or (m and t[m.end() :].strip() and m[2] in (None, "1")))


LINES = "relative_path string, n long, line string, code boolean, level int, title string"


def markdown_lines(files: DataFrame) -> DataFrame:
    """(relative_path, n, line, code, level, title): lines from 1; ``code`` marks
    code and HTML; level and title where a heading starts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, text in zip(batch.column("relative_path"), batch.column("text")):
                lines = re.sub("\r\n?", "\n", text.as_py() or "").split("\n")
                code, level, title = zip(*structure(lines))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()] * len(lines), pa.string()), pa.array(range(1, len(lines) + 1), pa.int64()), pa.array(lines, pa.string()), pa.array(code, pa.bool_()), pa.array(level, pa.int32()), pa.array(title, pa.string())],
                    names=["relative_path", "n", "line", "code", "level", "title"],
                )

    return files.select("relative_path", "text").mapInArrow(run, LINES)
