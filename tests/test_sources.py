import json
import zipfile

import pytest

from bookloom.operators import changes, ingest
from bookloom.sources import archives, lists

FB2 = """<?xml version="1.0" encoding="{enc}"?>
<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info>
<genre>prose</genre><genre>history</genre><author><first-name>ЛЕВ</first-name><last-name>ТОЛСТОЙ</last-name></author>
<book-title>{title}</book-title><annotation><p>О войне &amp; мире</p></annotation><date>1869</date><lang>ru</lang>
<sequence name="Классика" number="2"/></title-info></description><body><section><p>Текст & ещё</p></section></body></FictionBook>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("a.fb2", FB2.format(enc="utf-8", title='"Война  и мир".').encode())
        z.writestr("b.fb2", FB2.format(enc="windows-1251", title="Сёстры").encode("cp1251"))
        z.writestr("readme.txt", "x")
    with zipfile.ZipFile(tmp_path / "sub" / "TWO.ZIP", "w") as z:
        z.writestr("c.FB2", b"x" * 5000)
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    return tmp_path


def test_archives(spark, folder):
    found = archives.list_archives(spark, str(folder))
    assert found.count() == 3
    rows = {(r.archive.rsplit("/", 1)[1], r.entry): r for r in archives.read_entries(found, max_bytes=4000).collect()}
    assert set(rows) == {("one.zip", "a.fb2"), ("one.zip", "b.fb2"), ("TWO.ZIP", "c.FB2"), ("broken.zip", None)}
    assert rows["TWO.ZIP", "c.FB2"].error == "too large" and "unreadable" in rows["broken.zip", None].error
    one = archives.read_entries(found, entries=["b.fb2"]).where("error IS NULL").collect()
    assert [r.entry for r in one] == ["b.fb2"]


def test_ingest(spark, folder):
    entries = archives.read_entries(archives.list_archives(spark, str(folder)))
    parsed = ingest.parse_metadata(ingest.decoded(entries)).cache()
    rows = {r.entry: r for r in parsed.collect()}
    a, b = rows["a.fb2"], rows["b.fb2"]
    assert (a.title, a.authors, a.genres, a.series, a.ser_no, a.lang, a.docdate) == ("Война и мир", ["Толстой ЛЕВ"], ["prose", "history"], "Классика", 2, "ru", "1869")
    assert a.annotation == "О войне &amp; мире" and "Текст" in a.body_sample and b.title == "Сёстры" and a.issues == []
    assert rows["c.FB2"].authors == [ingest.UNKNOWN_AUTHOR] and "no root" in rows["c.FB2"].issues
    tables = ingest.child_tables(parsed.where("size(issues) = 0"))
    assert tables["book_author"].count() == 2 and tables["book_genre"].count() == 4
    dim = changes.get_or_create(spark.createDataFrame([(5, "prose")], "id long, name string"), tables["book_genre"])
    assert sorted((r.id, r.name) for r in dim.collect()) == [(5, "prose"), (6, "history")]
    report = {r.cat_name.rsplit("/", 1)[1]: (r.books_count, r.errors_count) for r in ingest.archive_reports(parsed).collect()}
    assert report == {"one.zip": (2, 0), "TWO.ZIP": (0, 1), "broken.zip": (0, 1)}


@pytest.mark.parametrize(
    "data, want",
    [
        (b"\xef\xbb\xbfabc", ("abc", None)),
        ("аб".encode("utf-16"), ("аб", None)),
        (b"\xff\xfe\0\0a", (None, "unsupported charset: utf-32")),
        (b"<\0?\0", (None, "unsupported charset: utf-16 without a byte order mark")),
        (b"<?xml version='1.0' encoding='koi8-r'?>\xc1", ("<?xml version='1.0' encoding='koi8-r'?>а", None)),
        (b"<?xml version='1.0' encoding='utf-8'?>a\xff\xfeb", ("<?xml version='1.0' encoding='utf-8'?>a\ufffdb", None)),
        (b"<?xml version='1.0' encoding='utf-8'?>" + b"\xff" * 65, (None, "damaged content")),
        (b"\xffabc", (None, "undeclared charset")),
        (b"<?xml version='1.0' encoding='big5'?>\xff", (None, "unsupported charset: big5")),
        (None, (None, "no content")),
    ],
)
def test_decode(data, want):
    assert ingest.decode_text(data) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("a\x01b\tc", "a b\tc"),
        ("1 < 2 <p>x</p>", "1 &lt; 2 <p>x</p>"),
        ('<?xml version="1.0"?><?bad?>', '<?xml version="1.0"?>&lt;?bad?>'),
        ("a & b &amp; &#12; &x;", "a &amp; b &amp; &#12; &amp;x;"),
        ('<?xml version="1.1"?>', '<?xml version="1.0"?>'),
        ("<empty-line/ <p>", "<empty-line/><p>"),
        ("</p <p>", "</p> <p>"),
        ("<langru</lang>", "<lang>ru</lang>"),
    ],
)
def test_repairs(spark, given, want):
    df = spark.createDataFrame([(given,)], "s string")
    assert df.select(ingest.repair_markup(df["s"])).first()[0] == want


def test_csv_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffAuthor,Title,Year\nX,"A ""b"", c",1999x\n,no author,1\nY, t ,\n', encoding="utf-8")
    rows = lists.read_csv_items(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.title, r.author, r.year) for r in rows] == [('A "b", c', "X", 1999), ("t", "Y", None)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        lists.read_csv_items(spark, str(tmp_path / "bad.csv"))
    df = spark.createDataFrame([("A;b, c;1900",), ("D;e\r",), ("no separator",), ("  ",), (";x",)], "value string")
    items, errors = lists.parse_lines(df)
    assert sorted((r.author, r.title, r.year) for r in items.collect()) == [("A", "b, c", 1900), ("D", "e", None)]
    assert [r.value for r in errors.collect()] == ["no separator"]


def test_json(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"name": "n", "items": [{"title": "t", "author": "a", "year": 3, "extra": {"k": "v"}}]}))
    assert [(r.title, r.year, r.extra) for r in lists.read_json_items(spark, str(tmp_path / "b.json")).collect()] == [("t", 3, {"k": "v"})]
    (tmp_path / "q.json").write_text(json.dumps([{"name": "a", "kind": "books", "query": "x"}, {"name": "a", "kind": "books", "query": "y"}]))
    with pytest.raises(ValueError):
        lists.read_query_set(spark, str(tmp_path / "q.json"))


def test_safe_paths(spark):
    df = spark.createDataFrame([("a/b.zip",), ("../x",), ("/etc",), ("a/../b",), ("C:\\x",), ("a..b",)], "p string")
    assert [r.p for r in df.where(archives.safe_relative(df["p"])).collect()] == ["a/b.zip", "a..b"]


def test_requests_have_a_largest_size(spark, tmp_path, monkeypatch):
    from bookloom.sources import lists

    (tmp_path / "r.json").write_text('{"name": "n", "items": [{"title": "t", "author": "a"}]}')
    assert lists.read_json_items(spark, str(tmp_path / "r.json")).count() == 1
    monkeypatch.setattr(lists, "MAX_REQUEST", 20)
    with pytest.raises(ValueError, match="20 bytes"):
        lists.read_json_items(spark, str(tmp_path / "r.json"))
