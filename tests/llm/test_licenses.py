import random
import re

import pytest

from bookloom.llm import licenses as L


@pytest.mark.parametrize(
    "text, postfix",
    [
        ("MIT", "mit"),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", "mit apache-2.0 bsd-3-clause and or"),
        ("(MIT OR Apache-2.0) AND X", "mit apache-2.0 or x and"),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", "gpl-2.0 classpath-exception-2.0 with mit or"),
        ("MIT OR", None),
        ("(MIT", None),
        ("MIT)", None),
        ("AND MIT", None),
        ("MIT X", None),
        ("", None),
    ],
)
def test_parse(text, postfix):
    found = L.parse_expression(text)
    assert (found and found[0]) == postfix


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, p) for p in L.BASE_PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return (
        len(words),
        len(places),
        min((i for i, _ in places), default=None),
        max((i for i, _ in places), default=None),
        ",".join(sorted({L.BASE_PHRASES[p] for _, p in places})),
    )


TEXTS = [
    None,
    "",
    "CC BY",
    "cc by cc by-cc by",
    "All rights reserved. all RIGHTS, reserved; GNU Lesser General Public License",
    "x" * 5000 + " cc\nby",
    "é cc by ü general public licensed general public license",
    "SPDX-License-Identifier: MIT OR Apache-2.0\nmore",
    "accc bycc by",
    "ÀB cc by " * 3000,
    "// SPDX-License-Identifier: MIT AND Apache-2.0",
    "// SPDX-License-Identifier: MIT OR NoSuchLicense",
    "// SPDX-License-Identifier: MIT AND NoSuchLicense",
    "spdx-license-identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR Proprietary) AND BSD-3-Clause\nspdx-license-identifier: X",
    "cc  \x00by퟿ all rights reserved all rights reserved",
]


def brute_labels(text):
    """Labels and score without automata: phrases by comparing words, tags by str.find, terms by enumerating choices."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    phrases = [*L.BASE_PHRASES.items(), *L.NOTICE_PHRASES.items()]
    labels = {label for p, label in phrases if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))}
    score, known = 0.4 ** len(labels), 0.0
    low, at = (text or "").lower(), -1
    for tag in L.EXACT_TAGS:
        while (at := low.find(tag, at + 1)) >= 0:
            found = L.longest_expression(re.match(r"[A-Za-z0-9.+\-:() \t]*", (text or "")[at + len(tag) :].lstrip(" \t"))[0])
            terms, binding, other = choices(found[1])
            labels |= binding | {f"or:{o}" for o in other} | {f"terms:{terms}"}
            known = max(known, sum(L.rank_of(b.split(" with ")[0]) < 6 for b in binding) / len(binding))
    return ",".join(sorted(labels)), 1 - score * (1 - 0.9 * known)


def choices(postfix):
    """Terms and names by listing all alternatives of an expression in the order of the text."""
    stack = []
    for t in postfix.split(" "):
        if t in ("and", "or", "with"):
            b, a = stack.pop(), stack.pop()
            if t == "or":
                stack.append(a + b)
            elif t == "and":
                stack.append([(max(x, y), p | q) for x, p in a for y, q in b])
            else:
                exc = next(iter(b[0][1]))
                stack.append([(2 if r == 3 and exc in L.LINKING.split() else r, {f"{n} with {exc}" for n in p}) for r, p in a])
        else:
            stack.append([(L.rank_of(t), {t})])
    rank, binding = min(stack[0], key=lambda c: c[0])
    return list(L.TERMS)[rank], binding, {n for _, p in stack[0] for n in p} - binding


def test_places(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in L.op4_licenses(spark, str(tmp_path)).collect()}
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in rows.items()} == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert rows[7].labels == "mit,or:apache-2.0,terms:permissive" and rows[0].labels == "" and rows[0].score == 0
    assert rows[4].labels == "gpl,lgpl,reserved" and all(0 <= r.score <= 1 for r in rows.values())
    for i, t in enumerate(TEXTS):
        assert (rows[i].labels, pytest.approx(rows[i].score)) == brute_labels(t)


def test_empty(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def scan(text):
    return L.scan_text(text, L.build_automaton(), L.tag_automaton())[2]


def test_long_expressions():
    ids = [f"LicenseRef-{i:04d}" for i in range(600)]
    for text in (" OR ".join(ids), f"({' AND '.join(ids)})", "(" * 3000 + " OR ".join(ids) + ")" * 3000):
        assert len(text) > 9000
        (found,) = scan(f"// SPDX-License-Identifier: {text} OR (MIT\nmore")
        assert found["text"] == text and found["licences"] == [i.lower() for i in ids]


def test_longest_prefix():
    draw = random.Random(1)
    for _ in range(3000):
        tokens = [draw.choice(["(", ")", "or", "AND", "with", "mit", "X", "y"]) for _ in range(draw.randint(0, 9))]
        parts = (" ".join(tokens[:n]) for n in range(len(tokens), 0, -1))
        part = next((p for p in parts if valid(p.split())), None)
        found = L.longest_expression(" ".join(tokens) + " ")
        assert (found and found[0]) == part


def valid(tokens):
    # the grammar, by reduction of brackets
    text = "".join({"(": "(", ")": ")", "or": "o", "and": "o", "with": "o"}.get(t.lower(), "x") for t in tokens)
    while (less := re.sub(r"\(x(ox)*\)", "x", text)) != text:
        text = less
    return re.fullmatch(r"x(ox)*", text) is not None


def test_tag_ends_expression():
    assert [e["text"] for e in scan("SPDX-License-Identifier: MIT OR SPDX-License-Identifier: X AND Y")] == ["MIT", "X AND Y"]
    assert len(scan("MIT OR SPDX-License-Identifier: MIT OR " * 20000)) == 20000


@pytest.mark.parametrize(
    "expression, terms, binding, alternatives, known",
    [
        ("MIT OR Apache-2.0", "permissive", ["mit"], ["apache-2.0"], 1),
        ("MIT AND Apache-2.0", "permissive", ["apache-2.0", "mit"], [], 1),
        ("GPL-3.0-or-later OR MIT", "permissive", ["mit"], ["gpl-3.0-or-later"], 1),
        ("GPL-3.0+ AND MIT", "strong copyleft", ["gpl-3.0+", "mit"], [], 1),
        ("MIT AND X", "unknown", ["mit", "x"], [], 0.5),
        ("MIT OR X", "permissive", ["mit"], ["x"], 1),
        ("GPL-2.0 WITH Classpath-exception-2.0", "weak copyleft", ["gpl-2.0 with classpath-exception-2.0"], [], 1),
        ("GPL-2.0 WITH Other-exception", "strong copyleft", ["gpl-2.0 with other-exception"], [], 1),
        ("(AGPL-3.0 OR MPL-2.0) AND (MIT OR ISC)", "weak copyleft", ["mit", "mpl-2.0"], ["agpl-3.0", "isc"], 1),
    ],
)
def test_evaluation(expression, terms, binding, alternatives, known):
    assert L.evaluate(L.parse_expression(expression)[0]) == (terms, binding, alternatives, known)


def test_evaluation_against_all_choices():
    draw = random.Random(2)
    names = ["MIT", "ISC", "GPL-2.0", "AGPL-3.0", "LGPL-2.1", "CC0-1.0", "Own"]

    def made(depth):
        if depth == 0 or draw.random() < 0.3:
            return draw.choice(names)
        return f"({made(depth - 1)} {draw.choice(['AND', 'OR'])} {made(depth - 1)})"

    for _ in range(500):
        text = made(4)
        postfix = L.parse_expression(text)[0]
        terms, binding, other, _ = L.evaluate(postfix)
        assert terms == choices(postfix)[0]
        assert sorted({*binding, *other}) == L.parse_expression(text)[1]
        assert max(L.rank_of(b) for b in binding) == list(L.TERMS).index(terms)


def test_other_tags():
    assert [(e["binding"], e["terms"]) for e in scan("License: MIT and more\nlicense: see the file\nLicence: GPL-2+ or Apache-2.0.\nlicensed under: unknown")] == [(["mit"], "permissive"), (["apache-2.0"], "permissive")]
    assert [e["binding"] for e in scan("see https://spdx.org/licenses/MIT.html, https://creativecommons.org/licenses/by-nc/4.0/ and www.gnu.org/licenses/gpl-3.0.html or opensource.org/licenses/nothing")] == [["mit"], ["cc-by-nc-4.0"], ["gpl-3.0"]]


def test_very_long_text(spark):
    ids = [f"LicenseRef-{i:06d}" for i in range(60_000)]
    text = "word " * 2_000_000 + "SPDX-License-Identifier: " + " AND ".join(ids) + " cc by" * 1000  # 11 MB
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = L.scan_licenses(df).selectExpr("n_words", "size(places) AS places", "size(expressions[0].binding) AS binding", "expressions[0].terms AS terms").first()
    assert row.places == 1000 and row.binding == 60_000 and row.terms == "unknown" and row.n_words == 2_000_000 + 3 + 60_000 * 3 - 1 + 2000


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "cc by", "x", 5)], "doc_id long, text string, places string, labels int")
    assert L.scan_licenses(df).columns == ["doc_id", "n_words", "places", "expressions"]


@pytest.mark.parametrize(
    "behind, parsed",
    [
        ("MIT or later", "mit"), ("GPL-2.0 or any later version", "gpl-2.0"), ("MIT/Apache-2.0", "mit apache-2.0 or"), ("(MIT / X11) AND Zlib", "mit x11 or zlib and"), ("MIT // see below", "mit"),
        ("not a license", None), ("see the file", None), ("Foo", "foo"), ("Foo OR MIT", "foo mit or"), ("LicenseRef-Mine text", "licenseref-mine"), ("DocumentRef-x:LicenseRef-y", "documentref-x:licenseref-y"),
        ("https://example.org/x", None), ("Acme-1.0 applies", "acme-1.0"), ("MIT license", "mit"), ("MIT AND", "mit"), ("GPL-2.0 WITH Classpath-exception-2.0 or later", "gpl-2.0 classpath-exception-2.0 with"),
    ],
)
def test_prose_behind_an_exact_tag_ends_the_expression(behind, parsed):
    found = L.scan_text(f"SPDX-License-Identifier: {behind}\n", L.build_automaton(), L.tag_automaton())[2]
    assert [e["parsed"] for e in found] == ([parsed] if parsed else [])
