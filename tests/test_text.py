import pytest
from pyspark.sql import functions as F

from bookloom.functions import text as T


def one(spark, *columns, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(
    "given, want",
    [("  Ёжик   в тумане  ", "ежик в тумане"), ("Война—и–мир", "война и мир"), ("«Мастер» 'и' Маргарита", "мастер и маргарита"), ("Café", "café"), ("Книга № 2", "книга 2"), (None, None), ("", "")],
)
def test_normalize(spark, given, want):
    df = spark.createDataFrame([(given,)], "s string")
    assert df.select(T.normalize(F.col("s"))).first()[0] == want == T.normalize_text(given)


@pytest.mark.parametrize(
    "fn, a, b, want",
    [
        (T.similarity, "талстой", "толстой лев", 0.333),
        (T.similarity, "океан", "окена", 0.333),
        (T.word_similarity, "загадка башни", "загадка старой заброшенной башни", 0.571),
        (T.word_similarity, "загадка башни", "загадка башмака", 0.786),
        (T.word_similarity, "толстй лев", "толстой лев", 0.643),
        (T.word_similarity, "тайна маяка", "тайна старого заброшенного маяка", 0.5),
        (T.similarity, "", "", 0.0),
        (T.word_similarity, "abc", "", 0.0),
    ],
)
def test_similarity(spark, fn, a, b, want):
    assert round(one(spark, fn(F.col("a"), F.col("b")), a=a, b=b), 3) == want


@pytest.mark.parametrize("given, want", [("451° по Фаренгейту", "451 по фаренгейту"), ("1984: А-фантазия", "1984"), ("Рассказ — Служанки", "рассказ"), ("Ёж", "ёж")])
def test_match_form(spark, given, want):
    assert one(spark, T.match_form(T.trim_subtitle(F.col("s"))), s=given) == want


@pytest.mark.parametrize(
    "given, want",
    [("ЛЕВ ТОЛСТОЙ", "ЛЕВ Толстой"), ("Лев Толстой", "Лев Толстой"), ("ГЕНРИХ VIII", "Генрих VIII"), ("АБВ", "АБВ"), ("«ВОЙНА» И МИР", "«Война» И МИР"), ("", "")],
)
def test_repair_case(spark, given, want):
    assert one(spark, T.repair_case(F.col("s")), s=given) == want


def test_small_functions(spark):
    assert one(spark, T.transliterate(F.col("s")), s="Щука и ёж, Объезд") == "Shhuka i jozh, Obezd"
    assert one(spark, T.strip_tags(F.col("s")), s="<p>a<b>b</b></p> \n c") == "a b c"
    assert one(spark, T.clean_title(F.col("s")), s=' "A   title"-. ') == "A title"
    assert one(spark, T.clean_anchor(F.col("s")), s="a b\n\x01c") == "abc"
    assert one(spark, T.escape_html(F.col("s")), s="<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, F.concat_ws("|", *[T.leading_int(F.lit(x)).cast("string") for x in ("12a", " -3", "x", "")])) == "12|-3|0|0"
    assert one(spark, *T.author_title(F.col("s")), s="Толстой: Война - и мир") == ("Толстой", "Война - и мир")
    assert one(spark, *T.author_title(F.col("s")), s="no separator") == ("", "no separator")
    assert one(spark, *T.author_title(F.col("s")), s="a-b: ") == ("a", "b:")


def test_download_names(spark):
    rows = [("Война и мир!", "vojna_i_mir_"), ("Щука № 2", "shhuka_2"), ("C++ — book", "c_book"), ("", "")]
    got = spark.createDataFrame([(a,) for a, _ in rows], "t string").select(T.download_name(F.col("t"))).collect()
    assert [r[0] for r in got] == [b for _, b in rows]
