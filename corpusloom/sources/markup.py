"""HTML and office files as blocks, with archive guards and hidden-run findings.  Only the standard library is used.

Every function works on one file's bytes and returns rows; a file that can't be read becomes a warning row, never an error."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RATIO, MAX_BYTES = 100, 200 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
BLOCK = "block_ord int, type string, text string, page int, section_path array<string>"
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_SILENT = {"script", "style", "template", "noscript", "head"}
_BLOCKS = {"p", "li", "td", "th", "div", "article", "section", "pre", "blockquote", "tr", "table", "ul", "ol", "nav", "body", "title", *_HEADINGS}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.text, self.silent, self.kind, self.path = [], [], 0, "paragraph", []

    def flush(self, kind: str = "paragraph"):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            if kind in _HEADINGS:
                self.path = self.path[: _HEADINGS[kind] - 1] + [text]
            self.rows.append(("heading" if kind in _HEADINGS else "paragraph", text, None, list(self.path)))

    def handle_starttag(self, tag, attrs):
        self.silent += tag in _SILENT
        if tag in _BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in _SILENT))
        if tag in _BLOCKS:
            self.flush(tag)

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def html_blocks(html: str | None) -> list[tuple]:
    """(type, text, page, section_path) of headings and paragraphs, in order; scripts, styles and the head are left out."""
    p = _Page()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.rows


def bomb(data: bytes) -> str | None:
    """Why an archive must not be unpacked, by its directory alone; None if it may."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            sizes = [(i.file_size, i.compress_size) for i in z.infolist()]
    except zipfile.BadZipFile:
        return None
    worst = max((a / b if b else float(a > 0) * (MAX_RATIO + 1) for a, b in sizes), default=0.0)
    if worst > MAX_RATIO:
        return f"a member expands {worst:.0f} times"
    if sum(a for a, _ in sizes) > MAX_BYTES:
        return f"the members hold {sum(a for a, _ in sizes)} bytes"
    return None


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    """Members in the order of their numbers, not of their names."""
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _white(value: str | None) -> bool:
    return (value or "").upper().endswith("FFFFFF")


def docx_rows(data: bytes) -> tuple[list[tuple], Counter]:
    """Blocks, and hidden runs by reason: vanished text, and white text without a contrasting ground."""
    rows, hidden, path = [], Counter(), []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for el in body if body is not None else ():
        for run in el.iter(f"{_W}r"):
            text = "".join(t.text or "" for t in run.iter(f"{_W}t"))
            prop = run.find(f"{_W}rPr")
            if prop is None or not text.strip():
                continue
            get = lambda tag: prop.find(f"{_W}{tag}")  # noqa: B023, E731
            off = {"0", "false", "off"}
            ground = get("highlight") is not None or (get("shd") is not None and not _white(get("shd").get(f"{_W}fill")) and get("shd").get(f"{_W}fill") not in (None, "auto"))
            if get("vanish") is not None and get("vanish").get(f"{_W}val", "1") not in off:
                hidden["vanish"] += 1
            elif get("color") is not None and _white(get("color").get(f"{_W}val")) and not ground:
                hidden["white"] += 1
        if el.tag == f"{_W}tbl":
            lines = ["| " + " | ".join(" ".join("".join(t.text or "" for t in c.iter(f"{_W}t")).split()) for c in r.iter(f"{_W}tc")) + " |" for r in el.iter(f"{_W}tr")]
            rows.append(("table", "\n".join(lines), None, list(path)))
            continue
        text = "".join(t.text or "" for t in el.iter(f"{_W}t")).strip()
        style = el.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"[Hh]eading ?(\d)", style.get(f"{_W}val", "")) if style is not None else None
        if text and level:
            path = path[: int(level[1]) - 1] + [text]
        if text:
            rows.append(("heading" if level else "paragraph", text, None, list(path)))
    return rows, hidden


def pptx_rows(data: bytes) -> tuple[list[tuple], Counter]:
    """A page for each slide; hidden: white runs, and runs under two points with four letters or more."""
    rows, hidden = [], Counter()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for page, name in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml"), 1):
            for par in ElementTree.fromstring(z.read(name)).iter(f"{_A}p"):
                text = "".join(t.text or "" for t in par.iter(f"{_A}t")).strip()
                if text:
                    rows.append(("paragraph", text, page, []))
                for run in par.iter(f"{_A}r"):
                    own = "".join((t.text or "") for t in run.iter(f"{_A}t"))
                    prop = run.find(f"{_A}rPr")
                    if prop is None or not own.strip():
                        continue
                    fill = prop.find(f"{_A}solidFill/{_A}srgbClr")
                    if fill is not None and _white(fill.get("val")):
                        hidden["white"] += 1
                    elif int(prop.get("sz") or 1800) < 200 and len("".join(own.split())) >= 4:
                        hidden["tiny"] += 1
    return rows, hidden


def xlsx_rows(data: bytes) -> tuple[list[tuple], Counter]:
    """A table for each sheet; hidden: white runs of shared and inline strings."""
    rows, hidden = [], Counter()

    def text(item) -> str:
        for run in item.iter(f"{_S}r"):
            color = run.find(f"{_S}rPr/{_S}color")
            if color is not None and _white(color.get("rgb")) and "".join(t.text or "" for t in run.iter(f"{_S}t")).strip():
                hidden["white"] += 1
        return "".join(t.text or "" for t in item.iter(f"{_S}t"))

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [text(i) for i in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        for page, name in enumerate(_numbered(z, r"xl/worksheets/sheet(\d+)\.xml"), 1):
            lines = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
                    cells.append(text(inline) if inline is not None else shared[int(v.text)] if v is not None and c.get("t") == "s" else (v.text or "") if v is not None else "")
                lines.append("| " + " | ".join(cells) + " |")
            if lines:
                rows.append(("table", "\n".join(lines), page, []))
    return rows, hidden


def read_file(kind: str, data: bytes) -> tuple[list[tuple], list[tuple[str, str]]]:
    """(blocks, warnings) of one file; any failure is a parse_error warning."""
    try:
        if kind in ("docx", "pptx", "xlsx"):
            why = bomb(data)
            if why:
                return [], [("parse_error", f"not unpacked: {why}")]
            rows, hidden = {"docx": docx_rows, "pptx": pptx_rows, "xlsx": xlsx_rows}[kind](data)
            return rows, [("hidden_text", f"{n} {reason} run(s)") for reason, n in sorted(hidden.items())]
        if kind == "html":
            return html_blocks(data.decode("utf-8-sig", "replace")), []
        if kind == "pdf":
            return [], [("import_error", "no PDF reader is installed")]
        return [], [("parse_error", f"no reader for {kind}")]
    except Exception as e:
        return [], [("parse_error", f"{type(e).__name__}: {e}")]


def blocks(files: DataFrame) -> DataFrame:
    """source_id, block rows and warnings of binary files (source_id, type, content)."""

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for s, k, c in zip(f["source_id"], f["type"], f["content"]):
                rows, warned = read_file(k, bytes(c))
                out += [(s, i, t, x, p, path, None, None) for i, (t, x, p, path) in enumerate(rows)] + [(s, None, None, None, None, None, w, m) for w, m in warned]
            g = pd.DataFrame(out, columns=["source_id", "block_ord", "type", "text", "page", "section_path", "warning", "message"])
            yield g.astype({"block_ord": "Int32", "page": "Int32"})

    return files.select("source_id", "type", "content").mapInPandas(run, f"source_id string, {BLOCK}, warning string, message string")


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, block_ord, type, text, section_path of HTML in a column."""

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [(k, i, t, x, path) for k, h in zip(f[key], f["html"]) for i, (t, x, _, path) in enumerate(html_blocks(h))]
            yield pd.DataFrame(out, columns=[key, "block_ord", "type", "text", "section_path"]).astype({"block_ord": "int32"})

    return pages.select(key, F.col(html).alias("html")).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, block_ord int, type string, text string, section_path array<string>")
