import pytest
from pyspark.sql import functions as F

from bookloom.functions import records as R
from bookloom.operators import documents


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize(
    "answer, want",
    [
        ('{"command":"find_book","title":" War "}', ("find_book", "war", "", "title_only")),
        ('Sure! {"command":"FIND_AUTHOR","author":"Tolstoy"} ok', ("find_author", "", "Tolstoy", "author_only")),
        ('{"command":"find_book_with_author","author":"T"}', ("find_book_with_author", "", "T", "combined")),
        ('{"command":"find_book"}', ("unknown", "", "", "")),
        ("no json", ("unknown", "", "", "")),
        ('{"command":"dance"}', ("unknown", "", "", "")),
    ],
)
def test_commands(spark, answer, want):
    assert tuple(one(spark, R.command_of(F.lit(answer)))) == want


def test_projections(spark):
    assert one(spark, R.display_name(F.lit(""), F.lit("g"))) == "g" and one(spark, R.display_name(F.lit("t"), F.lit("g"))) == "t"
    assert one(spark, R.cover_path(F.lit("/a.zip"), F.lit("1.fb2"))) == "a-zip/1-fb2.jpg"
    assert len(one(spark, R.revision_key(F.lit("m"), F.lit("v"), F.lit(1)))) == 16
    assert one(spark, R.valid_account(F.lit("a@b.c"), F.lit("x_1"), F.lit("12345678")))
    assert not one(spark, R.valid_account(F.lit("a@b"), F.lit("x 1"), F.lit("12345678")))


def test_fb2_blocks(spark):
    text = '<FictionBook><body><title><p>Head</p></title><section id="s1"><title><p>One</p></title><p>a <b>b</b></p><empty-line/><p>see <a l:href="#n1" type="note">1</a></p></section></body><body name="notes"><section id="n1"><p>note</p></section></body></FictionBook>'
    rows = documents.fb2_blocks(spark.createDataFrame([("d", text), ("e", None)], "id string, text string")).orderBy("seq").collect()
    assert [(r.kind, r.text, r.note_refs) for r in rows] == [("header", "Head", []), ("header", "One", []), ("p", "a b", []), ("p", "see 1", ["n1"])]


def test_fb2_blocks_of_whole_and_truncated_bodies(spark):
    whole = "<body><p>a</p><table><tr><th>x</th><td>y</td></tr></table><text-author>who</text-author></body><body name='notes'><p>n</p></body><body><p>b</p></body>"
    cut = "<body><title><p>T</p></title><p>one</p><p>two <emph"
    rows = documents.fb2_blocks(spark.createDataFrame([(1, whole), (2, cut)], "id long, text string")).orderBy("id", "seq").collect()
    assert [(r.kind, r.text) for r in rows] == [("p", "a"), ("tr", "x y"), ("text-author", "who"), ("p", "b"), ("header", "T"), ("p", "one"), ("p", "two")]


def test_event_types(spark):
    rows = spark.createDataFrame([("scan_error",), ("fix_scan_completed",), ("genre_title_gen_started",), ("other",), (None,)], "t string")
    assert [tuple(r) for r in rows.select(R.event_job(F.col("t")), R.event_ends(F.col("t"))).collect()] == [("scan", False), ("fix_scan", True), ("genre_title_gen", False), (None, False), (None, None)]
