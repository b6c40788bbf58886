"""Book readers on made-up files, and sinks that are read back."""

import io
import zipfile

import pytest

from pyspark.sql import functions as F

from lexloom.sources import books, sinks


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>She said <q>hi</q> and left.</p>", [("paragraph", "She said hi and left.")]),
        ("<blockquote><p>One.</p><p>Two.</p></blockquote><p>After</p>", [("quote", "One. Two."), ("paragraph", "After")]),
        ("<ul><li>a <p>b</p> c</li><li>d</li></ul>", [("paragraph", "a b c"), ("paragraph", "d")]),
        ("<ul><li>a<ul><li>b</li></ul>c</li></ul>", [("paragraph", "a bc")]),
        ("<p>one<p>two<h2>three</h2>", [("paragraph", "one"), ("paragraph", "two"), ("heading", "three")]),
        ("<ul><li>a<li>b</ul><p>c</p>", [("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c")]),
        ("<p>a<script>x</script>b</p><nav><p>menu</p></nav>", [("paragraph", "ab")]),
        ("<h1> </h1><p></p>", []),
        ("", []),
    ],
)
def test_blocks(html, expected):
    assert [(b[0], b[2]) for b in books.blocks_of(html)] == expected


def packed(**files: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_epub_chapters_follow_the_spine():
    opf = b'<package><manifest><item id="a" href="one.xhtml"/><item id="b" href="two.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>'
    z = packed(**{"META-INF/container.xml": b'<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>', "o/c.opf": opf, "o/one.xhtml": b"<p>first</p>", "o/two.xhtml": b"<h1>Two</h1><p>second</p>"})
    assert [(r[0], r[1], r[5]) for r in books.book_rows("x.epub", z)] == [(0, "Two", "Two"), (0, "Two", "second"), (1, "one", "first")]


def test_zipped_fb2_holds_one_book():
    fb2 = b"<FictionBook><body><section><p>t</p></section></body></FictionBook>"
    assert [r[5] for r in books.book_rows("x.fb2.zip", packed(a=b"", **{"b.fb2": fb2}))] == ["t"]
    assert [r[-1] for r in books.book_rows("x.fb2.zip", packed(a=b""))] == ["NO_FB2"]
    assert [r[-1] for r in books.book_rows("x.fb2.zip", packed(**{"a.fb2": fb2, "b.fb2": fb2}))] == ["SEVERAL_FB2"]
    assert next(iter(books.book_rows("x.epub", b"no zip")))[-1]


def test_decoding():
    text = "Привет"
    assert books.decoded(b'<?xml encoding="windows-1251"?>' + text.encode("cp1251")).endswith(text)
    assert books.decoded(text.encode()) == text
    assert books.decoded(text.encode("cp1251")) == text
    assert books.decoded(b'<?xml encoding="no-such"?>' + text.encode()).endswith(text)


SCHEMA = "id long, v string, updated int"


def stored(spark, path, key=("id",)):
    return sorted(tuple(r) for r in sinks.table(spark, path, list(key)).select("id", "v", "updated").collect())


def test_upsert_keeps_the_latest(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    sinks.append(df((1, "a", 1), (2, "b", 5), (3, "c", 1), (None, "x", 1)), path, ["id"], 4)
    sinks.upsert(df((1, "a2", 2), (2, "old", 4), (3, "c2", 1), (4, "d", None), (None, "y", 9)), path, ["id"], "updated", 4)
    assert stored(spark, path) == [(1, "a2", 2), (2, "b", 5), (3, "c2", 1), (4, "d", None)]
    sinks.upsert(df(), path, ["id"], "updated", 4)
    assert len(stored(spark, path)) == 4


def test_insert_absent_leaves_stored_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append(spark.createDataFrame([(1, "a", 1)], SCHEMA), path, ["id"], 4)
    sinks.insert_absent(spark.createDataFrame([(1, "b", 2), (2, "c", 1), (2, "c", 1)], SCHEMA), path, ["id"], 4)
    assert stored(spark, path) == [(1, "a", 1), (2, "c", 1)]


def test_replace_children_may_leave_none(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (3, "d", 1)], SCHEMA), path, ["id"], 4)
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    sinks.replace_children(spark.createDataFrame([(1, "n", 7), (3, "no", 7)], SCHEMA), parents, path, ["id"], 4)
    assert stored(spark, path) == [(1, "n", 7), (3, "d", 1)]


def test_blobs_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other"), (4, None)], "id long, content string")
    m = sinks.put_blobs(rows, path, buckets=4)
    sinks.put_blobs(rows, path, buckets=4)
    assert sorted((r.id, r.n_bytes) for r in m.collect() if r.sha256) == [(1, 4), (2, 4), (3, 5)]
    assert sorted(bytes(r.content) for r in sinks.table(spark, path, ["sha256"]).collect()) == [b"other", b"same"]


# --- inline runs


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>a <b>b</b><strong>c</strong> d</p>", [("a ", []), ("bc", ["bold"]), (" d", [])]),
        ("<p><i>x <b>y</b></i>z</p>", [("x ", ["italic"]), ("y", ["bold", "italic"]), ("z", [])]),
        ("<p>one<br>two <em>three<br/>four</em></p>", [("one\ntwo ", []), ("three\nfour", ["italic"])]),
        ("<p> <b> a </b> <b> b </b> </p>", [("a b", ["bold"])]),
        ("<p>a<b></b>b</p>", [("ab", [])]),
        ("<b><p>outer marks do not count</p></b>", [("outer marks do not count", [])]),
        ("<p><b>never closed</p><p>next</p>", [("never closed", ["bold"]), ("next", [])]),
        ("<p><b>a<i>b</b>c</i></p>", [("a", ["bold"]), ("b", ["bold", "italic"]), ("c", ["italic"])]),
    ],
)
def test_runs(html, expected):
    blocks = books.blocks_of(html)
    assert [(t, m) for b in blocks for t, m in b[4]] == expected
    assert all("".join(t for t, _ in b[4]) == b[2] for b in blocks)


def test_fb2_runs():
    fb2 = "<FictionBook><body><section><title><p>One</p><p>two</p></title><p>a <emphasis>b</emphasis><strong>c</strong><empty-line/>d</p><cite>\n <p>x</p>\n <p>y</p>\n</cite></section></body></FictionBook>"
    rows = [r for r in books.book_rows("x.fb2", fb2.encode())]
    assert [(r[3], r[5]) for r in rows] == [("heading", "One\ntwo"), ("paragraph", "a bc\nd"), ("quote", "x\ny")]
    assert rows[1][7] == [("a ", []), ("b", ["italic"]), ("c", ["bold"]), ("\nd", [])]


def plain_runs(html):
    """Runs by a walk over tags that knows nothing of the reader: right for pages whose blocks are not nested; a paragraph left
    open ends where another block or a container begins or ends."""
    import html as entities
    import re

    out, open_, marks, skip = [], None, [], 0
    for tag, text in re.findall(r"(<[^>]*>)|([^<]+)", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", html)):
        name = re.match(r"</?\s*([a-zA-Z0-9]*)", tag)[1].lower() if tag else ""
        if tag and name in ("nav", "head"):
            skip += -1 if tag[1] == "/" else 1
        elif skip:
            continue
        elif tag and open_ == "p" and (name != "p" or tag[1] != "/") and name in books.ENDS_P:
            out.append(pieces)  # noqa: F821
            open_ = None
            if tag[1] != "/" and name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"):
                open_, pieces, marks = name, [], []
        elif tag and name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "title") and (open_ is None or (open_ == name and tag[1] == "/")):
            if tag[1] == "/":
                out.append(pieces)  # noqa: F821
                open_ = None
            else:
                open_, pieces, marks = name, [], []
        elif tag and open_ and name == "br":
            pieces.append(("\n", frozenset(marks)))
        elif tag and open_ and name in ("b", "strong", "i", "em"):
            m = "bold" if name in ("b", "strong") else "italic"
            marks.remove(m) if tag[1] == "/" else marks.append(m)
        elif text and open_:
            pieces.append((entities.unescape(text), frozenset(marks)))
    blocks = []
    for pieces in out:
        chars = [(c, m) for t, m in pieces for c in t]
        flat = [(" " if c in " \t\r\f\v" else c, m) for c, m in chars]
        kept = [(c, m) for i, (c, m) in enumerate(flat) if not (c == " " and i and flat[i - 1][0] == " ")]
        while kept and kept[-1][0].isspace():
            kept.pop()
        while kept and kept[0][0].isspace():
            kept.pop(0)
        runs = []
        for c, m in kept:
            if runs and runs[-1][1] == sorted(m):
                runs[-1][0] += c
            else:
                runs.append([c, sorted(m)])
        if runs:
            blocks.append([(t, m) for t, m in runs])
    return blocks


def test_runs_of_all_pages(spark):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    read = {}
    for r in books.html_blocks(pages).collect():
        read.setdefault(r.page_id, []).append((r.block, [(x.text, list(x.marks)) for x in r.runs]))
    nested, checked = re.compile(r"<(li|blockquote|h[1-6])\b[^>]*>((?!</\1>).)*<(p|li|blockquote|h[1-6]|ul|ol|pre|div|table)\b", re.S), 0
    for page in pages.collect():
        if not nested.search(page.html):
            assert [x for _, x in sorted(read.get(page.page_id, []))] == plain_runs(page.html), page.page_id
            checked += 1
    assert checked > 30


def test_golden_lines_keep_their_numbers(spark, tmp_path):
    lines = ['{"id": "a", "bookId": "b", "question": "q", "expectedParagraphIds": ["1"], "minRecallK": 5}', "", "not json", '{"id": "c", "bookId": "b", "question": " ", "expectedParagraphIds": ["1"]}', '{"id": "d", "bookId": "b", "question": "q", "expectedParagraphIds": []}', '{"bookId": "b"}', "[1]"]
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    got = {r.line: (r.id, r.error) for r in books.golden(spark, str(tmp_path / "g.jsonl")).collect()}
    assert got == {1: ("a", None), 3: (None, "not JSON"), 4: ("c", "no question"), 5: ("d", "no expectedParagraphIds"), 6: (None, "no id"), 7: (None, "not JSON")}


# --- payloads


def test_corpora_good_and_broken(spark, tmp_path):
    import gzip
    import hashlib
    import json

    from lexloom.sources import payloads

    def corpus(book, version="book-text-corpus-v1", chapters=()):
        return gzip.compress(json.dumps({"schemaVersion": version, "bookId": book, "chapters": [{"chapterId": c, "orderIndex": o, "title": "t", "rawText": x} for c, o, x in chapters]}).encode(), mtime=0)

    good = corpus("b1", chapters=[("c2", 2, "two"), ("c1", 1, "one"), ("", 3, "no id"), ("c9", 0, "no place"), ("old3", 3, "by place")])
    data = {"a/good.gz": good, "a/cut.gz": good[:-12], "a/hash.gz": good, "a/size.gz": good, "a/json.gz": gzip.compress(b"{oops"), "a/list.gz": gzip.compress(b"[]"), "a/version.gz": corpus("b5", "v0"), "a/book.gz": corpus(" ")}
    for name, content in data.items():
        (tmp_path / "store" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "store" / name).write_bytes(content)
    sha = lambda n: hashlib.sha256(data[n]).hexdigest()
    rows = [(n, len(data[n]), sha(n), "gzip") for n in data] + [("a/gone.gz", None, None, None), ("a/good.gz", None, None, "zstd"), ("a/good.gz", None, "", None)]
    rows = [(n, 7 if "size" in n else s, "0" * 64 if "hash" in n else None if h == "" else h and h.upper(), c) for n, s, h, c in rows]
    manifest = spark.createDataFrame(rows, "storage_key string, size_bytes long, sha256 string, compression string")
    read = payloads.corpora(manifest, payloads.blobs(spark, str(tmp_path / "store")))
    got = sorted((r.storage_key, r.error or "", r.book_id or "") for r in read.collect())
    assert got == sorted([("a/good.gz", "", "b1"), ("a/good.gz", "", "b1"), ("a/good.gz", "COMPRESSION", ""), ("a/cut.gz", "GZIP", ""), ("a/hash.gz", "CHECKSUM", ""), ("a/size.gz", "SIZE", ""), ("a/json.gz", "JSON", ""), ("a/list.gz", "JSON", ""), ("a/version.gz", "VERSION", ""), ("a/book.gz", "BOOK", ""), ("a/gone.gz", "MISSING", "")])
    one = read.where("error is null").first()
    assert [(c.order_index, c.chapter_id, c.text) for c in one.chapters] == [(1, "c1", "one"), (2, "c2", "two"), (3, "old3", "by place")]
    table = spark.createDataFrame([("b1", "c1", 1, "T", "own"), ("b1", "c3", 3, "T", "own"), ("b1", "c4", 4, "T", "own"), ("b1", "c5", 5, "T", None), ("b2", "c1", 1, "T", "other")], "book_id string, chapter_id string, order_index int, title string, raw_text string")
    texts = payloads.chapter_texts(table, read.where("storage_key = 'a/good.gz'").limit(1))
    assert sorted((r.book_id, r.chapter_id, r.text or "", r.origin) for r in texts.collect()) == [("b1", "c1", "one", "blob"), ("b1", "c3", "by place", "place"), ("b1", "c4", "own", "table"), ("b1", "c5", "", "missing"), ("b2", "c1", "other", "table")]
    assert payloads.corpora(manifest.limit(0), payloads.blobs(spark, str(tmp_path / "store"))).count() == 0


def test_artifacts_override_their_rows(spark, tmp_path):
    import gzip

    from lexloom.sources import payloads

    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.gz").write_bytes(gzip.compress(b'{"summary": "new", "n": 5}'))
    (tmp_path / "s" / "bad.gz").write_bytes(b"no gzip")
    rows = spark.createDataFrame([(1, "x.gz", "old", 1, "k"), (2, None, "old", 1, "k"), (3, "bad.gz", "old", 1, "k"), (4, "none.gz", "old", 1, "k")], "id int, storage_key string, summary string, n int, kept string")
    got = {r.id: (r.summary, r.n, r.kept, r.error) for r in payloads.artifacts(rows, payloads.blobs(spark, str(tmp_path / "s")), ["summary", "n", "kept"]).collect()}
    assert got == {1: ("new", 5, "k", None), 2: ("old", 1, "k", None), 3: ("old", 1, "k", "GZIP"), 4: ("old", 1, "k", "MISSING")}
    same = spark.createDataFrame([('{"a": 1}',)] * 2, "j string").select(payloads.encoded(F.col("j")).alias("b")).collect()
    assert same[0].b == same[1].b and gzip.decompress(bytes(same[0].b)) == b'{"a": 1}'
