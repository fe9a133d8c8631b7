from datetime import datetime
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from bookloom.operators import changes, dedup, documents, evaluate, filters, ingest, lists, ranges, rescan, resolve, state
from bookloom.plans import maintenance


def test_verdicts(spark):
    schema = "name string, relevant long, recall_at_k double, reciprocal_rank double, zero_result boolean"
    base = spark.createDataFrame([("a", 1, 1.0, 1.0, False), ("b", 1, 0.5, 0.5, False)], schema)
    verdict = lambda rows: evaluate.compare_runs(spark.createDataFrame(rows, schema), base).first()
    assert verdict([("a", 1, 1.0, 1.0, False), ("b", 1, 0.5, 0.5, False), ("c", 1, 0.0, 0.0, True)]).verdict == "pass"
    assert verdict([("a", 1, 1.0, 1.0, False)]).missing == ["b"]
    lost = verdict([("a", 1, 1.0, 1.0, False), ("b", 1, 9.0, 0.0, False)])
    assert lost.lost == ["b"] and lost.verdict == "regression"
    fell = verdict([("a", 1, 0.9, 1.0, False), ("b", 1, 0.5, 0.5, False)])
    assert fell.regressed == ["a"] and fell.verdict == "regression"


def test_percentiles(spark):
    df = spark.createDataFrame([("x", v) for v in (40, 10, 30, 20)], "g string, v long")
    assert tuple(evaluate.percentiles(df, ["g"], "v", {"a": 0.5, "b": 0.95}).first())[1:] == (20, 40)
    assert tuple(evaluate.floor_rank(df, ["g"], "v", {"a": 0.5, "b": 1.0}).first())[1:] == (30, 40)


def test_buckets(spark):
    items = spark.createDataFrame([(i, "a", f"t{i}") for i in range(6)], "item_id long, author_norm string, title_norm string")
    decided = spark.createDataFrame([("a", "t0", 99)], "author_norm string, title_norm string, book_id long")
    found = [(1, 7, 0.9, 1), (2, 7, 0.5, 1), (3, 7, 0.9, 1), (3, 8, 0.9, 2), (3, 9, 0.4, 3), (4, 7, 0.29, 1)]
    candidates = spark.createDataFrame(found, "item_id long, book_id long, score float, rank int")
    m = resolve.match_buckets(items, decided, candidates).cache()
    rows = {r.item_id: (r.status, r.book_id) for r in m.collect()}
    assert rows == {0: ("manual", 99), 1: ("auto_matched", 7), 2: ("ambiguous", None), 3: ("ambiguous", None), 4: ("not_found", None), 5: ("not_found", None)}
    books = spark.createDataFrame([(7, datetime(2020, 1, 2)), (8, datetime(2020, 1, 1)), (9, datetime(2021, 1, 1))], "id long, registerdate timestamp")
    assert {r.item_id: r.book_id for r in resolve.auto_resolve(m, books).collect()} == {2: 7, 3: 7}
    assert tuple(resolve.import_stats(m).first()) == (2, 2, 2, 6, 6)
    assert spark.range(1).select(resolve.recent(F.array(*map(F.lit, range(8))))).first()[0] == [3, 4, 5, 6, 7]


def test_duplicates(spark):
    df = dedup.hashed(spark.createDataFrame([(1, "x", "t1"), (2, "x", "t0"), (3, "y", "t"), (4, None, "t"), (5, None, "t")], "id long, content string, title string"))
    (g,) = dedup.duplicate_groups(df).collect()
    assert (g["count"], g.book_ids, g.example_titles) == (2, [1, 2], ["t0", "t1"])
    hidden = dedup.hide_duplicates(df)
    assert [(r.id, r.duplicate_of_id) for r in hidden.where("duplicate_hidden").collect()] == [(1, 2)]
    assert dedup.audit_keepers(hidden).count() == 0


def test_changes(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, changes.upsert(t, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, changes.insert_missing(t, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    fav = spark.createDataFrame([(1, 5, 9)], "id long, user_id long, book_id long")
    assert changes.toggle_favorite(fav, 5, 9, False).count() == 0 and changes.toggle_favorite(fav, 5, 8, True, 2).count() == 2
    assert sorted(map(tuple, changes.exists_any(t, spark.createDataFrame([(2,), (9,), (2,), (None,)], "id long"), ["id"]).collect()), key=repr) == [(2, True), (9, False), (None, False)]
    assert changes.export_tables({"t": t, "u": t}, ["t"], str(tmp_path / "out")) == ["t"] and spark.read.parquet(str(tmp_path / "out" / "t")).count() == 2
    t.write.parquet(str(tmp_path / "leak" / "secret"))
    with pytest.raises(ValueError, match="secret"):
        changes.export_tables({"t": t}, ["t"], str(tmp_path / "leak"))
    log = spark.createDataFrame([(1, 1, "run"), (1, 2, "done"), (2, 1, "run")], "job_id long, at long, status string")
    assert {r.job_id: r.status for r in changes.latest_jobs(log).collect()} == {1: "done", 2: "run"}
    assert spark.range(1).select(changes.percent(F.lit(2), F.lit(3)), changes.percent(F.lit(1), F.lit(0))).first()[:] == (66, 0)


def test_portions(spark):
    note = lambda n, c: {"id": n, "cost": c}
    rows = [("a", 0, 40, []), ("a", 1, 30, [note("n", 20)]), ("a", 2, 30, [note("n", 20)]), ("a", 3, 500, []), ("a", 4, 10, []), ("b", 0, 5, None)]
    df = spark.createDataFrame(rows, "id string, seq int, cost int, notes array<struct<id: string, cost: bigint>>")
    got = {(r.id, r.seq): (r.portion, r.error) for r in documents.pack_portions(df, 100, 400).collect()}
    assert got == {("a", 0): (0, None), ("a", 1): (0, None), ("a", 2): (1, None), ("a", 3): (2, "too large"), ("a", 4): (3, None), ("b", 0): (0, None)}


def test_documents(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(documents.standard_language(F.lit(x))) for x in ("rus", "RU", "ger", "deu", "klingon", "xx", "")] == ["ru", "ru", "de", "de", "unknown", "xx", ""]
    assert [one(documents.image_kind(F.unhex(F.lit(h)))) for h in ("FFD8FF00", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "00")] == ["jpeg", "png", "gif", "webp", "unknown"]


def test_state(spark):
    rows = [(1, datetime(2024, 1, 1, 0, 0, s)) for s in (0, 10, 20)] + [(1, datetime(2024, 1, 1, 0, 1, 0)), (1, datetime(2024, 1, 1, 0, 1, 59))]
    out = state.fixed_windows(spark.createDataFrame(rows, "key long, ts timestamp"), limit=2).orderBy("ts").collect()
    assert [(r["count"], r.allowed, r.retry_after) for r in out] == [(1, True, None), (2, True, None), (3, False, 40), (1, True, None), (2, True, None)]
    df = spark.createDataFrame([(1, i, "user", "x" * 2000) for i in range(4)] + [(2, 0, "user", "y" * 9000)], "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.turn) for r in state.trim_conversations(df).collect()) == [(1, 3), (2, 0)]


def test_small_helpers(spark):
    assert lists.page_count(101, 100) == 2 and lists.has_next(90, 10, 101) and not lists.has_next(91, 10, 101)
    df = spark.createDataFrame([(1, "b"), (2, "a")], "id long, username string")
    assert [r.id for r in df.orderBy(*lists.dynamic_order("username", False)).collect()] == [2, 1]
    assert [r.id for r in df.orderBy(*lists.dynamic_order("drop table", True)).collect()] == [2, 1]


class Blocks(HTMLParser):
    """Blocks by an HTML parser: kind and text between the tags of block elements."""

    OTHER = ["html", "head", "body", "nav", "ul", "div", "article", "footer", "table", "tr", "td", "pre", "section"]
    KINDS = {"p": "p", "li": "li", "title": "title", **{f"h{i}": "header" for i in range(1, 7)}, **dict.fromkeys(OTHER, "text")}

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.rows, self.kind, self.text, self.silent = [], "text", "", False
        self.feed(html)
        self.close()
        self.flush("text")

    def flush(self, kind):
        if text := " ".join(self.text.split()):
            self.rows.append((self.kind, text))
        self.kind, self.text = kind, ""

    def tag(self, tag, kind):
        self.text += " "
        if tag in self.KINDS:
            self.flush(kind)

    def handle_starttag(self, tag, attrs):
        self.silent = tag in ("script", "style")
        self.tag(tag, self.KINDS.get(tag))

    def handle_endtag(self, tag):
        self.silent = False
        self.tag(tag, "text")

    def handle_data(self, data):
        self.text += "" if self.silent else data

    def handle_entityref(self, name):
        self.text += f"&{name};"

    def handle_charref(self, name):
        self.text += f"&#{name};"

    def handle_comment(self, data):
        self.text += " "


PAGES = [
    "<html><head><title>T &amp; t</title><style>p{}</style></head><body><h1>H</h1><p>one<p>two</p><p>three <b>bold</b><p>last</body></html>",
    "<div>ad</div><ul><li>a<li>b<ul><li>c</ul>after</ul>tail<footer>foot</footer>",
    "lead <i>in</i><!-- <p>no</p> --><script>var t='</p><p>x';</script><P class='x' id=\"a\">up</P>rest",
    "<p>x < y and z > w <pre>  kept\n text</pre><param name=p>more<table><tr><td>1<td>2</table><p>cut",
    "<div><p>open</div><section><h2>Head<p>para</section>end<script>p('<p>never closed')",
    "",
    None,
]


def test_html_blocks_equal_parser(spark):
    rows = documents.html_blocks(spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")).orderBy("id", "seq").collect()
    for i, page in enumerate(PAGES):
        assert [(r.kind, r.text) for r in rows if r.id == i] == Blocks(page or "").rows
    assert [r.text for r in rows if r.anchor] == ["up"]


def test_html_blocks_keep_open_paragraphs(spark):
    rows = documents.html_blocks(spark.createDataFrame([(0, "<article><h1>H</h1><p>a<p>b</p><p>c</article><footer>f")], "page_id long, html string"))
    assert [(r.kind, r.text) for r in rows.orderBy("seq").collect()] == [("header", "H"), ("p", "a"), ("p", "b"), ("p", "c"), ("text", "f")]


def test_portions_charge_notes(spark):
    notes = [(str(i), 90_000) for i in range(500)]
    df = spark.createDataFrame([("a", 0, 100, notes)], "id string, seq int, cost long, notes array<struct<id:string,cost:long>>")
    packed = documents.pack_portions(df)
    assert [(r.charged, r.error) for r in packed.collect()] == [(100 + 500 * 90_000, "too large")]
    assert documents.portion_sizes(packed, 40 << 20).first().too_large


def test_portions_against_brute_force(spark):
    lines = {r.doc_id: r.text.split("\n") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in maintenance.chunk_pack_notes(spark, "/root/testdata/sf0.001").collect():
        portion, size, seen, total, errors = 1, 0, set(), 0, 0
        for seq, line in enumerate(lines[r.id], 1):
            note = seq % 4 if seq % 3 == 0 else None
            cost = len(line.encode())
            extra = 0 if note is None or note in seen else 300
            if size and size + cost + extra > 1024:
                portion, size, seen = portion + 1, 0, set()
                extra = 0 if note is None else 300
            size, total = size + cost + extra, total + cost + extra
            seen |= set() if note is None else {note}
            errors += cost + (0 if note is None else 300) > 500
        assert (r.portions, r.bytes, r.too_large, r.errors) == (portion, total, total > 20000, errors)


def test_running_sums(spark):
    rows = [(g, v, i) for i, (g, v) in enumerate([("a", k % 7) for k in range(300)] + [(None, k) for k in range(50)] + [("b", None)] * 3)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    got = {r.i: (r.upto, r.all) for r in ranges.running_sum(df, ["g"], ["v", "i"], F.lit(1), "upto", "all").collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == [(k + 1, len(own)) for k in range(len(own))]
    assert ranges.running_sum(df.limit(0), ["g"], ["v"], F.lit(1), "n").count() == 0


def test_link_prefixes(spark):
    one = lambda t: spark.range(1).select(ingest.repair_markup(F.lit(t))).first()[0]
    assert one('<a xmlns:xlink="x"><b l:href="#n"/></a>') == '<a xmlns:xlink="x"><b xlink:href="#n"/></a>'
    assert one('<a xmlns:l="x" xmlns:xlink="x"><b l:href="#n"/></a>') == '<a xmlns:l="x" xmlns:xlink="x"><b l:href="#n"/></a>'
    assert one('<a><b l:href="#n"/></a>') == '<a><b l:href="#n"/></a>'


def test_languages(spark):
    codes = {"swe": "sv", "ara": "ar", "heb": "he", "hrv": "hr", "sqi": "sq", "alb": "sq", "nno": "nn", "no": "nb", "lav": "lv", "slovene": "sl", "tgl": "tl", "gle": "ga", "welsh": "cy", "xyz": "xy", "marathi": "mr"}
    rows = spark.createDataFrame(list(codes.items()), "tag string, code string")
    assert rows.where(documents.standard_language(F.col("tag")) != F.col("code")).isEmpty()


def test_split_query(spark):
    df = spark.createDataFrame([('"war" by x by y',), ("war",), (" by y",), ("war by ",), ('" by z',)], "query string")
    assert [(r.title, r.author) for r in filters.split_query(df).collect()] == [("war", "x by y"), ("war", None), ("", None), ("war", None), ("", None)]


def test_export_and_report(spark, tmp_path):
    tables = {n: spark.range(3) for n in ("book", "author", "user")}
    assert changes.export_tables(tables, ["book", "author"], f"{tmp_path}/out") == ["author", "book"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["author", "book"]
    with pytest.raises(ValueError, match="no such tables: nothing"):
        changes.export_tables(tables, ["book", "nothing"], f"{tmp_path}/other")
    changes.write_report(tables["book"].agg(F.count("*").alias("n")), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first().n == 3


def test_decisions(spark):
    pending = spark.createDataFrame([(i, ("a",), ("b",)) for i in range(4)], "id long, old struct<title:string>, new struct<title:string>")
    decisions = spark.createDataFrame([(0, True, None), (1, True, (False,)), (2, False, None), (2, True, None)], "id long, approved boolean, flags struct<title:boolean>")
    stays, applied = rescan.decide(pending, decisions, ["title"])
    assert [r.id for r in stays.collect()] == [3] and sorted((r.id, r.title) for r in applied.collect()) == [(0, "b"), (1, "a")]


def test_doubled_changes_give_one_row(spark):
    books = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, title string, lang string")
    twice = spark.createDataFrame([(1, "n1", None, 5), (1, "n2", "y", 4), (1, "n2", "y", 4), (2, None, "z", 1)], "id long, title string, lang string, at int")
    assert sorted(map(tuple, changes.patch(books, twice, ["title", "lang"]).collect())) == [(1, "n2", "y"), (2, "b", "z")]
    assert sorted(map(tuple, changes.patch(books, twice, ["title", "lang"], latest=["at"]).collect())) == [(1, "n1", "x"), (2, "b", "z")]
    items = spark.createDataFrame([(1, None, "ambiguous", 0.5, "{}"), (2, 7, "ambiguous", 0.5, "{}")], "id long, book_id long, match_status string, match_score float, external_extra string")
    chosen = spark.createDataFrame([(1, 8, 2), (1, 9, 1), (1, 9, 1)], "item_id long, book_id long, at int")
    assert sorted((r.id, r.book_id) for r in changes.resolve_items(items, chosen).collect()) == [(1, 9), (2, 7)]
    assert sorted((r.id, r.book_id) for r in changes.resolve_items(items, chosen, ["at"]).collect()) == [(1, 8), (2, 7)]
    again = spark.createDataFrame([(1, "auto_matched", 3, 0.8, "p"), (1, "ambiguous", None, 0.9, "q"), (2, "not_found", None, 0.0, "r")], "item_id long, status string, book_id long, score double, extra string")
    assert sorted((r.id, r.book_id, r.match_status, r.external_extra) for r in changes.rewrite_items(items, again).collect()) == [(1, None, "ambiguous", "q"), (2, 7, "not_found", "r")]
    old = spark.createDataFrame([(1, "p", "f", "t", "an", "en", "d", False)], "id long, path string, filename string, title string, annotation string, lang string, docdate string, cover boolean")
    parsed = [("p", "f", "t1", None, "de", None, True, None), ("p", "f", "t9", None, "de", None, True, "broken"), ("p", "f", "t0", None, "de", None, True, None)]
    (r,) = rescan.fix_scan(old, spark.createDataFrame(parsed, "path string, filename string, title string, annotation string, lang string, docdate string, cover boolean, error string")).collect()
    assert (r.title, r.cover, r.scan_error) == ("t1", True, None)


def test_running_sum_beside_like_names_in_one_exchange(spark):
    rows = [(g, v, (v or 0) % 3, 7) for g in ("a", None) for v in (5, 1, 9, None, 5, 2)]
    df = spark.createDataFrame(rows, "_g0 string, _range long, _value int, _before int")
    got = ranges.running_sum(df, ["_g0"], ["_range", "_value"], F.lit(1), "_inside", "_all")
    assert got.columns == ["_g0", "_range", "_value", "_before", "_inside", "_all"]
    assert sorted((r[0] or "", r[1] or 0, r[4], r[5]) for r in got.collect()) == [(g, v, i + 1, 6) for g in ("", "a") for i, v in enumerate((0, 1, 2, 5, 5, 9))]
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan or "ReusedQueryStage" in plan


def test_a_scan_is_counted_by_its_own_write(spark, tmp_path):
    rows = [(i, f"a{i % 3}", f"{i}.fb2", "t", None, "en", None, False) for i in range(30)]
    books = spark.createDataFrame(rows, "id long, path string, filename string, title string, annotation string, lang string, docdate string, cover boolean")
    found = [(p, f, "new", None, "en", None, True, "broken" if i % 5 == 0 else None) for i, p, f, *_ in rows if i % 7]
    scanned = rescan.fix_scan(books, spark.createDataFrame(found, "path string, filename string, title string, annotation string, lang string, docdate string, cover boolean, error string"))
    report, errors = rescan.write_scan(scanned, str(tmp_path / "scan"))
    want = rescan.scan_report(scanned).first()
    assert report == {"total": want.total, "updated": want.updated, "failed": want.failed} == {"total": 30, "updated": 20, "failed": 10}
    assert errors.collect() == rescan.first_errors(scanned).collect()
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(scan_error)" in plan and "title" not in plan  # the parsed rows are not worked out again


def brute_links(links, asked, dim):
    """Entry by entry, as a program with a dictionary would do it."""
    ids, names = {i: n for i, n in dim}, {}
    for i, n in sorted(dim, reverse=True):
        names[n] = i
    taken, wanted = {}, set()
    for book in sorted(asked):
        given, seen = set(), set()
        for i, name, no in asked[book]:
            name = (name or "").strip(" ") or None
            if i and i in ids:
                taken.setdefault(book, []).append((i, no))
            elif name and (i or name.lower() not in seen):
                if not i:
                    seen.add(name.lower())
                wanted |= {name} - set(names)
                taken.setdefault(book, []).append((name, no))
        assert not given
    top = max(ids, default=0)
    new = {n: top + k + 1 for k, n in enumerate(sorted(wanted))}
    out = [x for x in links if x[0] not in asked]
    for book, entries in taken.items():
        seen = set()
        for m, no in entries:
            m = m if isinstance(m, int) else names.get(m, new.get(m))
            if m not in seen:
                seen.add(m)
                out.append((book, m, no))
    return sorted(out), sorted((i, n) for n, i in new.items())


def test_links_of_changed_books(spark):
    dim = [(1, "Ann Lee"), (2, "Bob"), (3, "Cid"), (7, "bob")]
    links = [(1, 1, 5), (1, 2, 6), (2, 3, 1), (3, 1, 1), (5, 2, 2)]
    asked = {1: [(2, None, 1), (2, "x", 2), (0, "New Name", 3), (None, " new name ", 4), (0, "Bob", 5), (0, "BOB", 6)], 2: [], 3: [(99, None, 1), (99, "Zed", 2), (98, "Zed", 3), (0, "  ", 4), (3, "anything", 5)], 4: [(0, "bob", 1), (7, None, 2), (0, "Abe", 3)]}
    frame = spark.createDataFrame([*asked.items(), (5, None)], "book_id long, entries array<struct<id: long, name: string, ser_no: int>>")
    got, new = changes.set_links(spark.createDataFrame(links, "book_id long, ser_id long, ser_no int"), frame, spark.createDataFrame(dim, "id long, name string"), "ser_id", ["ser_no"])
    want, created = brute_links(links, asked, dim)
    assert sorted(map(tuple, got.collect())) == want and sorted(map(tuple, new.collect())) == created
    assert created == [(8, "Abe"), (9, "New Name"), (10, "Zed")]
