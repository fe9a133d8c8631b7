import pytest
from pyspark.sql import functions as F

from bookloom.operators.search import BookSearch, search_books
from bookloom.operators.title_index import TitleIndex, bucket_of, sure_grams
from bookloom.plans.catalog import star_catalog
from bookloom.sources.batches import BatchStore

SF = "/root/testdata/sf0.001"
TITLES = ["Война и мир", "Мир и война", "Ёжик в тумане", "Красный виджет", "red widget", "hundred widgets", "Red: The Widget", "a", "red", "widget reds", "Café noir", None, "", "rewidget", "re d wid", "talstoy", "tolstoy lev"]


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    catalog = star_catalog(spark, SF)
    index = TitleIndex(BatchStore(spark, str(tmp_path_factory.mktemp("index"))))
    assert index.upsert(0, catalog.book)
    return catalog, index


@pytest.mark.parametrize("needle, more", [("red widget", {"lang": "de"}), ("widget re", {"limit": 5, "offset": 3}), ("smal wigdet", {"author_id": 3}), ("re", {}), ("idge", {}), ("!!", {})])
def test_same_pages_as_without_an_index(star, needle, more):
    catalog, index = star
    r = BookSearch(query=needle, **more)
    assert index.search(catalog, r).collect() == search_books(catalog, r).collect()


def books(spark, titles, first=1):
    rows = [(first + i, t, "en", True, False) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "id long, title string, lang string, approved boolean, duplicate_hidden boolean")


def test_upserts_keep_the_index_in_step(spark, tmp_path):
    from bookloom.plans.catalog import Catalog

    store = BatchStore(spark, str(tmp_path))
    index = TitleIndex(store)
    index.upsert(0, books(spark, TITLES))
    now = {i + 1: t for i, t in enumerate(TITLES)}
    for needle in ("red widget", "cafe", "ежик в туман", "wid"):
        held, sure = {x.id for x in index.candidates(needle).collect()}, search_books(Catalog(book=books(spark, TITLES)), BookSearch(query=needle)).collect()
        assert {x.id for x in sure if x.id is not None} <= held

    def same():
        frame = spark.createDataFrame([(i, t, "en", True, False) for i, t in now.items()], "id long, title string, lang string, approved boolean, duplicate_hidden boolean")
        for needle in ("red widget", "война", "talstoy"):
            r = BookSearch(query=needle)
            assert index.search(Catalog(book=frame), r).collect() == search_books(Catalog(book=frame), r).collect(), needle

    same()
    index.upsert(1, books(spark, ["blue widget", "red gadget"], 5), spark.createDataFrame([(2,)], "id long"))
    now |= {5: "blue widget", 6: "red gadget"}
    del now[2]
    index.upsert(2, books(spark, ["Война"], 2), spark.createDataFrame([(5,)], "id long"))
    now |= {2: "Война"}
    del now[5]
    same()
    assert not index.upsert(2, books(spark, ["again"], 2)) and index.titles().count() == len(now)


def test_sure_grams():
    assert sure_grams("red widget") == (["red", "ed ", "  w", " wi", "wid", "idg", "dge", "get"], ["  r", " re", "red", "  w", " wi", "wid", "idg", "dge", "get"])
    assert sure_grams("ab") == ([], ["  a", " ab"]) and sure_grams("") == ([], [])


def test_rare_needles_read_little(star):
    _, index = star
    postings = index._read("posting", "gram string, id long")
    rows = lambda grams: postings.where(F.col("gram").isin(grams)).count()
    common, rare = index.chosen_grams("red widget"), index.chosen_grams("zzzz widget")
    assert rows(rare) < rows(common) < postings.count() / 3
    plan = index.candidates("red widget")._jdf.queryExecution().executedPlan().toString()
    assert all("bucket" in line for line in plan.split("\n") if "PartitionFilters" in line and "posting" in line) and {bucket_of(g) for g in common} <= set(range(64))
