import random
import re

import pytest

from bookloom.operators import markup_tree as M


def brute(text, containers, max_depth=M.MAX_DEPTH, max_nodes=M.MAX_NODES, max_binaries=M.MAX_BINARIES):
    """A parser with a stack: nodes (node, parent, depth, name, text) and the verdict."""
    text = re.sub(r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>", " ", text or "")
    stack, nodes, own, binaries = [], [], {}, 0
    verdict = None
    for seq, raw in enumerate(re.findall("<[^<]*", text)):
        m = re.match(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*?(/?)>", raw)
        name = m[2].lower() if m else ""
        if name in containers and not m[3]:
            if m[1]:
                if not stack or stack[-1][1] != name:
                    verdict = ("unbalanced", seq)
                    break
                stack.pop()
            else:
                binaries += name == "binary"
                fault = "too deep" if len(stack) == max_depth else "too many" if len(nodes) == max_nodes else "too many binaries" if binaries > max_binaries else None
                if fault:
                    verdict = (fault, seq)
                    break
                nodes.append((seq, stack[-1][0] if stack else None, len(stack) + 1, name))
                stack.append((seq, name))
        if stack:
            own.setdefault(stack[-1][0], []).append(re.sub(r"^</?[A-Za-z][^>]*>", " ", raw))
    squeeze = lambda parts: re.sub("[\t\n\r ]+", " ", " ".join(parts)).strip(" ")
    return [(*n, squeeze(own.get(n[0], []))) for n in nodes], verdict or ("open" if stack else "whole", None)


def random_markup(r, broken):
    names = ["section", "title", "p", "cite", "table", "tr", "td"]
    out, stack = [], []
    for _ in range(r.randint(0, 60)):
        k = r.random()
        if k < 0.4:
            stack.append(r.choice(names))
            out.append(f'<{stack[-1].upper() if r.random() < 0.1 else stack[-1]} id="a{r.randint(0, 9)}">')
        elif k < 0.7 and stack:
            out.append(f"</{stack.pop() if not broken or r.random() < 0.97 else 'p'}>")
        else:
            out.append(r.choice(["some text\n ", "<b>bold</b>", "a < b & c", "<p/>", "<br>", "<!-- <p> -->", "<image l:href='#x'/>", " ", "жук"]))
    return "".join(out) + "".join(f"</{s}>" for s in reversed(stack) if not broken)


@pytest.mark.parametrize("broken, limits", [(False, {}), (True, {}), (True, {"max_depth": 3}), (False, {"max_nodes": 5})])
def test_equals_a_parser_with_a_stack(spark, broken, limits):
    r = random.Random(len(limits) + broken)
    texts = [(i, random_markup(r, broken)) for i in range(120)] + [(900, None), (901, ""), (902, "no tags"), (903, "<p>" * 40), (904, "</p>"), (905, "<p>cut <sec"), (906, "<section><p>x</section>")]
    placed = M.placed_tokens(M.tag_tokens(spark.createDataFrame(texts, "id long, text string"), M.FB2), **limits).cache()
    nodes = {}
    for n in M.tree_nodes(placed).collect():
        nodes.setdefault(n.id, []).append((n.node, n.parent, n.depth, n.name, n.text))
    verdicts = {v.id: (v.verdict, v.at, v.elements) for v in M.tree_verdicts(placed).collect()}
    seen = set()
    for i, t in texts:
        want, (verdict, at) = brute(t, M.FB2, **limits)
        assert sorted(nodes.get(i, [])) == want
        assert verdicts.get(i, ("whole", None, 0)) == (verdict, at, len(want))
        seen.add(verdict)
    assert len(seen) > 1


def test_sections_tables_and_notes_of_a_book(spark):
    text = """<FictionBook><description><title-info><book-title>T</book-title></title-info></description>
    <body><title><p>Head</p></title><section id="s1"><title><p>One</p></title><p>Text <a l:href="#n1" type="note">1</a> more.</p>
    <section id="s2"><p>Inner</p><table><tr><td>a</td><td>b</td></tr></table></section></section></body>
    <body name="notes"><section id="n1"><title><p>1</p></title><p>First <emphasis>note</emphasis>.</p><p>Its end.</p></section><section id="n2"><p>Second.</p></section></body>
    <binary id="c.jpg">AAAA</binary></FictionBook>"""
    nodes = M.markup_tree(spark.createDataFrame([(1, text), (2, text.replace("First", "Other"))], "id long, text string"), M.FB2).cache()
    rows = {r.node: r for r in nodes.where("id = 1").collect()}
    by_path = [(r.path, r.text) for r in sorted(rows.values())]
    assert ("/fictionbook/body/section/section/table/tr/td", "a") in by_path and ("/fictionbook/body/section/p", "Text 1 more.") in by_path
    (inner,) = [r for r in rows.values() if r.anchor == "s2"]
    assert rows[inner.parent].anchor == "s1" and [rows[a].name for a in inner.ancestors] == ["fictionbook", "body", "section"]
    notes = {(r.id, r.note): r.text for r in M.note_texts(nodes).collect()}
    assert notes == {(1, "n1"): "1 First note . Its end.", (1, "n2"): "Second.", (2, "n1"): "1 Other note . Its end.", (2, "n2"): "Second."}


def test_what_comes_first_decides(spark):
    text = "<section>" + "<binary>x</binary>" * 3 + "<p></section>"
    for limits, want in (({}, ("unbalanced", 8)), ({"max_binaries": 2}, ("too many binaries", 5)), ({"max_nodes": 2, "max_binaries": 2}, ("too many", 3)), ({"max_depth": 1}, ("too deep", 1))):
        placed = M.placed_tokens(M.tag_tokens(spark.createDataFrame([(1, text)], "id long, text string"), M.FB2), **limits)
        (v,) = M.tree_verdicts(placed).collect()
        assert (v.verdict, v.at) == want
