"""Book sources: EPUB, FB2 (plain or zipped) and HTML as rows of blocks, by Python table functions over binary files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = {**{f"h{i}": ("heading", i) for i in range(1, 7)}, "title": ("subtitle", 2), "subtitle": ("subtitle", 2), "p": ("paragraph", 0), "li": ("paragraph", 0), "blockquote": ("quote", 0), "q": ("quote", 0), "pre": ("poem", 0)}
SKIPPED = ("script", "style", "nav", "head")
MARKS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "emphasis": "italic"}
RUNS = "array<struct<text: string, marks: array<string>>>"
SCHEMA = f"chapter int, chapter_title string, block int, type string, level int, text string, marks array<string>, runs {RUNS}, error string"


#: A paragraph without end tag ends where one of these begins or ends.
ENDS_P = {"p", "li", "ul", "ol", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "div", "table", "section", "article", "header", "footer", "main", "aside", "nav", "figure", "form", "td", "th", "body", "html"}


def runs_of(pieces: list[tuple[str, tuple[str, ...]]]) -> list[tuple[str, list[str]]]:
    """Runs of text with the same marks: white space but line breaks becomes one blank, none stands at a block's ends, and
    neighbours with the same marks are one run. Together the runs' texts are the block's."""
    out: list[list] = []
    blank = False
    for text, marks in pieces:
        kept = []
        for c in re.sub(r"[ \t\r\f\v]+", " ", text):
            if c != " " or not blank:
                kept.append(c)
            blank = c == " "
        if kept:
            names = sorted(set(marks))
            if out and out[-1][1] == names:
                out[-1][0] += "".join(kept)
            else:
                out.append(["".join(kept), names])
    for at, strip in ((-1, str.rstrip), (0, str.lstrip)):
        while out:
            out[at][0] = strip(out[at][0])
            if out[at][0]:
                break
            out.pop(at)
    return [(text, names) for text, names in out]


class _Blocks(HTMLParser):
    """Blocks of a page as (type, level, text, marks used, runs). The outermost block holds all text to its own end tag; what stands
    inside it counts as inline. End tags that HTML lets out are put in for p and li."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.skip, self.text, self.marks = [], None, 0, [], []
        self.tag, self.depth, self.lists = "", 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            if self.open and self.tag == "p" and tag in ENDS_P:
                self._end()
            self.skip += 1
            return
        if self.open and ((self.tag == "p" and tag in ENDS_P) or (self.tag == tag == "li" and not self.lists)):
            self._end()
        if self.open:
            self.depth += tag == self.tag
            self.lists += tag in ("ul", "ol")
            if tag == "br":
                self._add("\n")
            elif tag in BLOCKS and tag != "q":
                self._add(" ")
            elif tag in MARKS:
                self.marks.append(tag)
        elif tag in BLOCKS:
            self.open, self.tag, self.depth, self.lists = BLOCKS[tag], tag, 1, 0

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.open and self.tag == "p" and tag in ENDS_P - {"p", "li", "ul", "ol"}:
            self._end()
        elif self.open and tag in MARKS:
            if tag in self.marks:  # the innermost of its kind ends
                del self.marks[len(self.marks) - 1 - self.marks[::-1].index(tag)]
        elif self.open and tag in ("ul", "ol"):
            if self.tag == "li" and not self.lists:
                self._end()
            self.lists = max(0, self.lists - 1)
        elif self.open and tag == self.tag:
            self.depth -= 1
            if not self.depth:
                self._end()

    def handle_data(self, data):
        if self.open and not self.skip:
            self._add(data)

    def _add(self, text):
        self.text.append((text, tuple(MARKS[t] for t in self.marks)))

    def _end(self):
        runs = runs_of(self.text)
        if self.open and runs:
            self.out.append((*self.open, "".join(t for t, _ in runs), sorted({m for _, names in runs for m in names}), runs))
        self.open, self.text, self.marks = None, [], []


def blocks_of(html: str) -> list[tuple]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser._end()
    return parser.out


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def decoded(data: bytes) -> str:
    """Text of FB2 bytes: the declared encoding, else UTF-8, with few bad bytes if need be, else windows-1251."""
    if m := re.search(rb"encoding=[\"']([A-Za-z0-9._-]+)", data[:200]):
        try:
            return data.decode(m[1].decode())
        except (LookupError, UnicodeDecodeError):
            pass
    loose = data.decode("utf-8", "replace")
    return loose if loose.count("�") <= 0.002 * len(loose) else data.decode("cp1251", "replace")


#: Elements of FB2 that stand on lines of their own within a block.
LINES = ("p", "v", "stanza", "subtitle", "text-author")


def _fb2(data: bytes) -> Iterator[tuple[str, list[tuple]]]:
    root = ElementTree.fromstring(re.sub(r"<\?xml[^>]*\?>", "", decoded(data), count=1))
    body = next(b for b in root.iter() if _local(b) == "body" and (b.get("name") or "").lower() != "notes")

    def pieces(e, marks: tuple[str, ...]) -> Iterator[tuple[str, tuple[str, ...]]]:
        """An element's text in order, line ends in the source as blanks; inner paragraphs and empty lines part lines."""
        own = (*marks, MARKS[_local(e)]) if _local(e) in MARKS else marks
        if _local(e) in ("empty-line", "br"):
            yield "\n", marks
            return
        lines = any(_local(x) in LINES for x in e)
        plain = lambda t: [] if lines and not (t or "").strip() else [(re.sub(r"\s+", " ", t or ""), own)]  # noqa: E731  layout between lines is no text
        yield from plain(e.text)
        for i, x in enumerate(e):
            if _local(x) in LINES and i:
                yield "\n", own
            yield from pieces(x, own)
            yield from plain(x.tail)

    def walk(e, depth: int, out: list) -> None:
        for x in e:
            kind = _local(x)
            runs = [] if kind == "section" else runs_of(list(pieces(x, ())))
            text, marks = "".join(t for t, _ in runs), sorted({m for _, names in runs for m in names})
            if kind == "section":
                walk(x, depth + 1, out)
            elif text and kind == "title":
                out.append(("heading", min(6, depth), text, marks, runs))
            elif text and kind in ("p", "subtitle", "cite", "epigraph", "poem"):
                out.append(({"p": "paragraph", "subtitle": "subtitle", "cite": "quote", "epigraph": "quote", "poem": "poem"}[kind], 2 if kind == "subtitle" else 0, text, marks, runs))

    for section in (s for s in body if _local(s) == "section"):
        out: list[tuple] = []
        walk(section, 1, out)
        yield (out[0][2] if out and out[0][0] == "heading" else ""), out


def _epub(data: bytes) -> Iterator[tuple[str, list[tuple]]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(e) == "rootfile")
        root = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href") for e in root.iter() if _local(e) == "item"}
        for ref in (e.get("idref") for e in root.iter() if _local(e) == "itemref"):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[ref]))
            out = blocks_of(z.read(name).decode("utf-8", "replace"))
            title = next((b[2] for b in out if b[0] in ("heading", "subtitle")), posixpath.splitext(posixpath.basename(name))[0])
            if out:
                yield title, out


def book_rows(path: str, data: bytes, most: int = 50 * 2**20) -> Iterator[tuple]:
    """Rows of SCHEMA; a file that cannot be read is one row with an error."""
    try:
        name = path.lower()
        if name.endswith(".fb2.zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                inside = [i for i in z.infolist() if i.filename.lower().endswith(".fb2")]
                if len(inside) != 1:
                    raise ValueError("NO_FB2" if not inside else "SEVERAL_FB2")
                if inside[0].file_size > most:
                    raise ValueError("TOO_LARGE")
                data, name = z.read(inside[0]), name.removesuffix(".zip")
        chapters = _fb2(data) if name.endswith(".fb2") else _epub(data) if name.endswith(".epub") else [("", blocks_of(data.decode("utf-8", "replace")))] if name.endswith((".html", ".htm")) else None
        if chapters is None:
            raise ValueError("UNSUPPORTED")
        for c, (title, found) in enumerate(chapters):
            for b, (kind, level, text, marks, runs) in enumerate(found):
                yield c, title, b, kind, level, text, marks, runs, None
    except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
        yield None, None, None, None, None, None, None, None, str(e) or type(e).__name__


class _BookTable:
    def eval(self, path: str, content: bytes):
        yield from book_rows(path, content)


def books(spark: SparkSession, path: str) -> DataFrame:
    """path and the blocks of every book file below a folder."""
    spark.udtf.register("book_blocks", F.udtf(_BookTable, returnType=SCHEMA))
    spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").createOrReplaceTempView("book_files")
    return spark.sql("SELECT f.path, b.* FROM book_files f, LATERAL book_blocks(f.path, f.content) b")


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id and the blocks of every page, in page order; Arrow batches, as the parser is Python."""

    def batches(it):
        import pandas as pd

        for g in it:
            rows = [(p, n, kind, level, text, [{"text": t, "marks": m} for t, m in runs]) for p, h in zip(g["page_id"], g["html"], strict=True) for n, (kind, level, text, _, runs) in enumerate(blocks_of(h or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "block", "type", "level", "text", "runs"])

    return pages.select("page_id", "html").mapInPandas(batches, f"page_id long, block int, type string, level int, text string, runs {RUNS}")


GOLDEN = "id string, bookId string, question string, category string, expectedParagraphIds array<string>, expectedKeywords array<string>, minRecallK int"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines golden set: file, line (from 1), the fields of GOLDEN, and an error where a line is no JSON object
    or lacks a required field. Blank lines are none. A file is read whole to number its lines; such sets are small."""
    files = spark.read.format("text").option("wholetext", "true").load(path).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("i", "raw")).where("trim(raw) <> ''")
    rows = lines.select("file", (F.col("i") + 1).alias("line"), F.when(F.try_parse_json("raw").isNotNull() & F.ltrim("raw").startswith("{"), F.from_json("raw", GOLDEN)).alias("g"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    error = F.when(F.col("g").isNull(), "not JSON").when(blank(F.col("g.id")), "no id").when(blank(F.col("g.bookId")), "no bookId").when(blank(F.col("g.question")), "no question")
    error = error.when(F.coalesce(F.size("g.expectedParagraphIds"), F.lit(0)) <= 0, "no expectedParagraphIds")
    return rows.select("file", "line", "g.*", error.alias("error"))
