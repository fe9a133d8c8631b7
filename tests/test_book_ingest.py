import base64
import hashlib
import os
import zipfile

import pytest

from bookloom.functions.joins import spread_join
from bookloom.operators import book_ingest as I
from bookloom.sources.archive_source import read_archives
from bookloom.sources.batches import BatchStore

COVER = b"\xff\xd8\xff picture"


def fb2(title, authors=("Ann Lee",), genres=("sf",), series=None, lang="en", cover=False, encoding="utf-8", body="Some text."):
    people = "".join(f"<author><first-name>{a.split()[0]}</first-name><last-name>{a.split()[1]}</last-name></author>" for a in authors)
    tags = "".join(f"<genre>{g}</genre>" for g in genres)
    seq = f'<sequence name="{series[0]}" number="{series[1]}"/>' if series else ""
    page = '<coverpage><image l:href="#c.jpg"/></coverpage>' if cover else ""
    binary = f'<binary id="c.jpg" content-type="image/jpeg">{base64.b64encode(COVER).decode()}\n</binary>' if cover else ""
    info = f"<title-info>{tags}{people}<book-title>{title}</book-title><annotation><p>About it.</p></annotation>{page}<date>1999</date><lang>{lang}</lang>{seq}</title-info>"
    text = f'<?xml version="1.0" encoding="{encoding}"?><FictionBook xmlns:l="http://www.w3.org/1999/xlink"><description>{info}</description><body><section><p>{body}</p></section></body>{binary}</FictionBook>'
    return text.encode("cp1251" if encoding == "windows-1251" else encoding)


def archive(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in entries:
            z.writestr(name, data)


@pytest.fixture
def shelf(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    first = fb2("First Book", ["Ann Lee", "Bob Ray"], ["sf", "det"], ("Saga", 2), cover=True)
    archive(src / "a.zip", [("1.fb2", first), ("2.fb2", fb2("Second", ["Bob Ray"], ["sf", "sf"])), ("3.fb2", first), ("4.fb2", b"<FictionBook><description><title-info></title-info></description></FictionBook>"), ("5.fb2", b"junk")])
    archive(src / "b.zip", [("1.fb2", fb2("Третья", ["Иван Шмелёв"], ["prose"], ("Saga", 3), "ru", encoding="windows-1251"))])
    (src / "broken.zip").write_bytes(b"PK nothing")
    return src


def names(store, table, key="id"):
    return {r[key]: r["name"] for r in store.read(table, I.NAMED).collect()}


def catalog(store):
    author, genre, series = (names(store, t) for t in ("author", "genre", "series"))
    out = {}
    for b in store.read("book").collect():
        out[b.id] = [os.path.basename(b.path), b.filename, b.title, b.lang, b.cover, set(), set(), None]
    for r in store.read("book_author").collect():
        out[r.book_id][5].add(author[r.author_id])
    for r in store.read("book_genre").collect():
        out[r.book_id][6].add(genre[r.genre_id])
    for r in store.read("book_series").collect():
        out[r.book_id][7] = (series[r.ser_id], r.ser_no)
    return out


FIRST = {
    1: ["a.zip", "1.fb2", "First Book", "en", True, {"Lee Ann", "Ray Bob"}, {"sf", "det"}, ("Saga", 2)],
    2: ["a.zip", "2.fb2", "Second", "en", False, {"Ray Bob"}, {"sf"}, None],
    3: ["b.zip", "1.fb2", "Третья", "ru", False, {"Шмелёв Иван"}, {"prose"}, ("Saga", 3)],
}


def test_archives_to_catalog_in_two_batches(spark, tmp_path, shelf):
    store = BatchStore(spark, str(tmp_path / "store"))
    assert I.ingest(store, 0, read_archives(spark, str(shelf)))
    assert catalog(store) == FIRST and names(store, "author") == {1: "Lee Ann", 2: "Ray Bob", 3: "Шмелёв Иван"}
    ledger = {os.path.basename(r.cat_name): (r.books_count, r.errors_count) for r in store.read("ledger").collect()}
    assert ledger == {"a.zip": (2, 2), "b.zip": (1, 0)}  # the broken archive stays unscanned
    errors = {(os.path.basename(r.archive), r.entry): r.error for r in store.read("scan_error").collect()}
    assert errors["a.zip", "3.fb2"] == "duplicate" and errors["broken.zip", None].startswith("unreadable archive") and set(errors) == {("a.zip", "3.fb2"), ("a.zip", "4.fb2"), ("a.zip", "5.fb2"), ("broken.zip", None)}
    (cover,) = store.read("cover").collect()
    assert (cover.book_id, bytes(cover.data), cover.content_type) == (1, COVER, "image/jpeg") and cover.path.endswith("a-zip/1-fb2.jpg")
    assert {r.md5 for r in store.read("book").where("id = 1").collect()} == {hashlib.md5(zipfile.ZipFile(shelf / "a.zip").read("1.fb2")).hexdigest()}
    assert not I.ingest(store, 0, read_archives(spark, str(shelf)))  # again the same number: nothing
    archive(shelf / "c.zip", [("9.fb2", fb2("Fourth", ["Ann Lee", "Zed Abe"], ["new"], ("Other", 1))), ("8.fb2", fb2("Second", ["Bob Ray"], ["sf", "sf"]))])
    assert I.ingest(store, 1, read_archives(spark, str(shelf)))
    assert catalog(store) == FIRST | {4: ["c.zip", "9.fb2", "Fourth", "en", False, {"Lee Ann", "Abe Zed"}, {"new"}, ("Other", 1)]}
    assert names(store, "author")[4] == "Abe Zed" and len(names(store, "author")) == 4 and names(store, "series") == {1: "Saga", 2: "Other"}
    assert not os.path.exists(tmp_path / "store" / "staging") or not os.listdir(tmp_path / "store" / "staging")


@pytest.mark.parametrize("writes", [0, 4, 9, 10])
def test_a_crash_and_a_retry_leave_one_batch(spark, tmp_path, shelf, writes):
    class Crash(BaseException):
        pass

    class Dying(BatchStore):
        left = writes
        at_once = 1

        def commit(self, batch, tables):
            made = {n: self.table(df) for n, df in tables().items()}
            assert len(made) == 10
            return super().commit(batch, made)

        def table(self, df):
            def parquet(path):
                if not self.left:
                    raise Crash
                self.left -= 1
                df.write.parquet(path)

            return type("Table", (), {"schema": df.schema, "write": type("Writer", (), {"parquet": staticmethod(parquet)})})

        def _publish(self, batch, rows):
            raise Crash

        def _abort(self, folders):
            pass

    with pytest.raises(Crash):
        I.ingest(Dying(spark, str(tmp_path / "store")), 0, read_archives(spark, str(shelf)))
    store = BatchStore(spark, str(tmp_path / "store"))
    assert store.read("book", I.BOOK).count() == 0
    assert I.ingest(store, 0, read_archives(spark, str(shelf))) and catalog(store) == FIRST
    assert store.read("ledger").count() == 2 and store.clean() == writes


def test_covers_as_files(spark, tmp_path):
    rows = [("a/b-zip/1.jpg", b"abc"), ("a/b-zip/1.jpg", b"abcd"), ("../out.jpg", b"x"), ("/abs.jpg", b"x"), ("c.jpg", None), (None, b"q")]
    got = {r.path: r.bytes for r in I.write_covers(spark.createDataFrame(rows, "path string, data binary"), str(tmp_path / "covers")).collect()}
    assert got == {"a/b-zip/1.jpg": 4, "../out.jpg": None, "/abs.jpg": None, "c.jpg": None, None: None}
    assert (tmp_path / "covers/a/b-zip/1.jpg").read_bytes() == b"abcd" and not (tmp_path / "out.jpg").exists()
    assert [f for _, _, fs in os.walk(tmp_path) for f in fs if not f.startswith(".")] == ["1.jpg"]


def test_spread_join_equals_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)], "id long, name string")
    table = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "name string, v int")
    for how in ("inner", "left", "left_semi"):
        a, b = spread_join(rows, table, ["name"], ["id"], how), rows.join(table, ["name"], how)
        assert a.columns == b.columns and sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
