import pytest
from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.operators import search as S
from bookloom.plans.catalog import Catalog

TITLES = [
    ("exact", "Война и мир", 1), ("prefix", "Война и мир: полное издание", 1), ("allWords", "Мир и война", 4), ("substring", "Читаем Война и мир вместе", 4),
    ("typo", "Вайна и мир", 4), ("scattered", "Загадка старой заброшенной башни", 4), ("neighbour", "Загадка башмака", 4), ("transposition", "Океан", 4),
    ("yo", "Ёжик в тумане", 3), ("dash", "Война—и–мир", 1), ("quotes", "«Мастер» 'и' Маргарита", 2), ("decomposed", "Café", 4), ("numero", "Книга № 2", 4),
    ("spaces", "  Ёжик   в тумане  ", 3), ("dupA", "Сто лет одиночества", 1), ("dupB", "Сто лет одиночества", 2), ("hidden", "Война и мир", 1), ("unapproved", "Война и мир", 1),
    ("english", "Война и мир", 1), ("oneChar", "Я", 4), ("twoChar", "Он", 4), ("series", "Война и мир", 1), ("genre", "Война и мир", 1), ("collection", "Война и мир", 1),
    ("curated", "Война и мир", 1), ("ignored", "Война и мир", 1), ("fav", "Война и мир", 1),
]
NAMES = [t[0] for t in TITLES] + [f"r{i}" for i in range(510)]


@pytest.fixture(scope="module")
def catalog(spark):
    every = TITLES + [(f"r{i}", "Рассказы", 4) for i in range(510)]
    at = {n: i + 1 for i, n in enumerate(NAMES)}
    books = [(at[n], t, "fy" if n == "english" else "fx", n != "unapproved", n == "hidden") for n, t, _ in every]
    link = lambda rows, schema: spark.createDataFrame(rows, schema)
    book = link(books, "id long, title string, lang string, approved boolean, duplicate_hidden boolean")
    author = link([(1, "Толстой Лев"), (2, "Булгаков Михаил"), (3, "Козлов Сергей"), (4, "Другой Автор")], "id long, full_name string")
    return Catalog(
        book=book.withColumn("norm_title", T.normalize(F.col("title"))).cache(),
        author=author.withColumn("norm_name", T.normalize(F.col("full_name"))).cache(),
        book_author=link([(at[n], a) for n, _, a in every], "book_id long, author_id long"),
        favorite=link([(1, 7, at["fav"])], "id long, user_id long, book_id long"),
        book_series=link([(at["series"], 5, 1)], "book_id long, ser_id long, ser_no int"),
        book_genre=link([(at["genre"], 6)], "book_id long, genre_id long"),
        collection=link([(9, "c", True, True)], "id long, name string, is_public boolean, is_curated boolean"),
        collection_book=link([(8, at["collection"], 1)], "book_collection_id long, book_id long, position int"),
        collection_item=link([(1, 9, at["curated"], "manual"), (2, 9, at["ignored"], "ignored")], "id long, collection_id long, book_id long, match_status string"),
    )


def found(catalog, query="Война и мир", **k):
    rows = S.search_books(catalog, S.BookSearch(query=query, **({"lang": "fx"} | k))).orderBy("pos").collect()
    return [NAMES[r.id - 1] for r in rows if r.id], rows[0].total


WAR = ["fav", "exact", "dash", "series", "genre", "collection", "curated", "ignored", "prefix", "allWords", "substring", "typo"]


@pytest.mark.parametrize(
    "query, want",
    [
        ("Война и мир", WAR),
        ("тумане в ежик", ["yo", "spaces"]),
        ("загадка башни", ["scattered", "neighbour"]),
        ("ежик в туманю", ["yo", "spaces"]),
        ("Я", ["oneChar"]),
        ("во", ["fav", "exact", "dash", "series", "genre", "collection", "curated", "ignored", "prefix", "allWords", "substring"]),
        ("ом", []),
        ("окена", []),
        ("Café", ["decomposed"]),
        ("", []),
    ],
)
def test_titles(catalog, query, want):
    got, total = found(catalog, query)
    assert total == len(want) and (got == want if query != "во" else set(got) == set(want) and got[:9] == want[:9])


def test_scopes(catalog):
    assert found(catalog, lang="fy") == (["english"], 1)
    assert found(catalog, unapproved=True) == (["unapproved"], 1)
    assert found(catalog, unapproved=True, moderator=False)[1] == 12
    assert found(catalog, include_hidden=True)[0][:4] == ["fav", "exact", "dash", "hidden"]
    assert found(catalog, author_id=1)[1] == 9 and set(found(catalog, author_id=4)[0]) == {"allWords", "substring", "typo"}
    assert found(catalog, series_id=5)[0] == ["series"] and found(catalog, genre_id=6)[0] == ["genre"]
    assert found(catalog, collection_id=8)[0] == ["collection"] and found(catalog, curated_collection_id=9)[0] == ["curated"]
    assert found(catalog, favorites_of=7)[0] == ["fav"] and found(catalog, author_id=99) == ([], 0)
    assert [found(catalog, author_query=q)[1] for q in ("толстой", "то", "толстй лев", "козлов")] == [9, 9, 9, 0]
    assert found(catalog, query="", author_query="толстой") == ([], 0)
    assert found(catalog, query="zzz", book_id=1)[0] == ["exact"]
    assert found(catalog, book_id=NAMES.index("hidden") + 1) == ([], 0)


def test_pages(catalog):
    pages = [found(catalog, "Рассказы", limit=10, offset=o) for o in (0, 10, 500)]
    assert [t for _, t in pages] == [510] * 3 and len({n for p, _ in pages for n in p}) == 30
    with pytest.raises(ValueError):
        found(catalog, offset=-1)


def test_authors_and_suggestions(catalog):
    rows = S.search_authors(catalog, "талстой", "fx").collect()
    assert [(r.full_name, r.total) for r in rows] == [("Толстой Лев", 1)]
    got = S.suggest(catalog, "сто лет одиночества", "fx").where("kind = 'title'").collect()
    assert [(r.value, r["count"]) for r in got] == [("Сто лет одиночества", 2)]
    got = S.suggest(catalog, "рассказы", "fx", 8).where("kind = 'title'").collect()
    assert [(r.value, r["count"]) for r in got] == [("Рассказы", 510)]
    got = S.suggest(catalog, "толстой", "fx", kind="author").collect()
    assert [(r.value, r["count"]) for r in got] == [("Толстой Лев", 10)]
    assert [S.suggestion_split(15, k) for k in ("all", "title", "author")] == [(8, 7), (15, 0), (0, 15)]


def test_duplicate_links_do_not_multiply(catalog):
    twice = Catalog(**{**catalog.__dict__, "book_author": catalog.book_author.unionByName(catalog.book_author)})
    assert found(twice, author_id=1)[1] == 9
