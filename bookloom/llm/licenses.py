"""Licence scans: an Aho-Corasick automaton finds tags and notice phrases, a parser evaluates licence expressions.

The automaton runs over a text's words joined by single blanks, so a phrase is found wherever its words stand
consecutively. Tags (SPDX, License: fields, addresses of licence pages) are looked up in the raw text, and the
expression behind a tag goes through a shunting-yard parser for and / or / with: all of it, whatever its length, up to
the next tag. Its postfix form is evaluated against classes of terms: with `or` the licensee may take the side with
the lighter terms (the left one of equals), with `and` both sides bind, `with` lightens copyleft where the exception is
known. Everything is a function of one document: one pass, no shuffle.

Defined cases: a null text counts as empty and has no words, labels or score; equal texts give equal results, repeated
rows repeated ones; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import LOWER, small_batches

#: Phrases (words in lower case) and their labels; the first three are the base.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICE_PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "apache license": "apache",
    "mit license": "mit",
    "expat license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "2 clause bsd": "bsd-2-clause",
    "3 clause bsd": "bsd-3-clause",
    "permission to use copy modify and or distribute this software": "isc",
    "isc license": "isc",
    "boost software license": "bsl",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
    "gnu free documentation license": "gfdl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "this is free and unencumbered software": "unlicense",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "business source license": "busl",
    "server side public license": "sspl",
    "proprietary and confidential": "proprietary",
    "no part of this publication may be reproduced": "reserved",
}
#: Tags in lower case. Behind an exact one every id counts, behind a plain one (prose may use its words)
#: only known ids do, and behind an address the rest of the path is one id.
EXACT_TAGS = ["spdx-license-identifier:"]
PLAIN_TAGS = ["license:", "licence:", "licensed under:", "license-expression:"]
ADDRESS_TAGS = {"spdx.org/licenses/": "", "opensource.org/licenses/": "", "opensource.org/license/": "", "gnu.org/licenses/": "", "creativecommons.org/licenses/": "cc-", "creativecommons.org/publicdomain/": "cc-"}
#: Classes of terms from the lightest on, and the ids that belong to them.
TERMS = {
    "public domain": "0bsd blessing cc-zero cc0 cc0-1.0 unlicense wtfpl",
    "permissive": "afl-3.0 apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 cc-by cc-by-3.0 cc-by-4.0 curl expat hpnd isc libpng mit mit-0 ms-pl ncsa ofl-1.1 postgresql psf-2.0 python-2.0 unicode-3.0 upl-1.0 w3c x11 zlib",
    "weak copyleft": "cddl-1.0 cddl-1.1 cpl-1.0 epl-1.0 epl-2.0 eupl-1.2 ipl-1.0 lgpl-2.0 lgpl-2.1 lgpl-3.0 mpl-1.1 mpl-2.0 ms-rl osl-3.0",
    "strong copyleft": "cc-by-sa cc-by-sa-3.0 cc-by-sa-4.0 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 qpl-1.0 sleepycat",
    "network copyleft": "agpl-1.0 agpl-3.0 sspl-1.0",
    "restricted": "busl-1.1 cc-by-nc cc-by-nc-4.0 cc-by-nc-nd cc-by-nc-nd-4.0 cc-by-nc-sa cc-by-nc-sa-4.0 cc-by-nd cc-by-nd-4.0 proprietary",
    "unknown": "",
}
#: Exceptions that let other code link with code under strong copyleft.
LINKING = "autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 font-exception-2.0 gcc-exception-3.1 linux-syscall-note llvm-exception openssl-exception"
#: How much one kind of evidence counts towards the score.
TAG_WEIGHT, PHRASE_WEIGHT = 0.9, 0.6

_CLASSES = list(TERMS)
_RANK = {name: _CLASSES.index(k) for k, names in TERMS.items() for name in names.split()}
_UNKNOWN, _STRONG, _WEAK = (_CLASSES.index(k) for k in ("unknown", "strong copyleft", "weak copyleft"))
_LINKING = frozenset(LINKING.split())
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)
_EXPRESSION = re.compile(rb"[ \t]*([A-Za-z0-9.+\-:()/ \t]+)")
_ADDRESS = re.compile(rb"[A-Za-z0-9.+\-]+(?:/[0-9][A-Za-z0-9.]*)?")
_TOKEN = re.compile(r"[()/]|[^()/\s]+")
#: What an id that is not known looks like: a word with a digit or a hyphen in it, or a reference.
_ID_FORM = re.compile(r"(?:(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+|(?=[a-z.+]*[0-9-])[a-z0-9][a-z0-9.+-]*)$")
#: Words that follow `or` in prose and are no ids.
_PROSE = frozenset(["later", "newer", "above", "greater", "higher", "any", "other", "license", "licence"])
_OPERATORS = {"or": 1, "and": 2, "with": 3}
RESULT = (
    "n_words long, places array<struct<label:string,base:boolean,word:long>>, "
    "expressions array<struct<text:string,parsed:string,licences:array<string>,binding:array<string>,alternatives:array<string>,terms:string,known:double>>"
)


def rank_of(name: str) -> int:
    """The class of terms of an id; later versions and `only` forms count as the version named."""
    name = re.sub(r"(-only|-or-later|\+)$", "", name)
    return _RANK.get(name, _RANK.get(re.sub(r"^((?:l|a)?gpl-\d)$", r"\1.0", name), _UNKNOWN))


def parse_expression(text: str) -> tuple[str, list[str]] | None:
    """The expression in postfix order and its licence ids; None if it is not well formed."""
    found = longest_expression(text)
    return found[1:] if found and found[0] == text.strip() else None


def longest_expression(text: str, known_only: bool = False, in_prose: bool = False) -> tuple[str, str, list[str]] | None:
    """The longest run of tokens from the start that parses: text, postfix form, licence ids.

    A slash counts as `or`. One shunting-yard pass up to the first token that cannot follow, or that holds a tag and so
    begins the next expression, or is no id: behind a plain tag (known_only) only known ids are, behind an exact one
    (in_prose) also what has the form of an id, and any word that stands alone or between operators. It goes back to the last token at which the operand was complete and no
    bracket was open. There the stack has operators of rising rank only, three at most.
    """
    out: list[str] = []
    stack: list[str] = []
    ids: list[str] = []
    operand = True  # whether an operand may come next
    depth, best = 0, None
    for m in _TOKEN.finditer(text):
        low = "or" if m[0] == "/" else m[0].lower()
        if low in _OPERATORS:
            if operand:
                break
            while stack and stack[-1] != "(" and _OPERATORS[stack[-1]] >= _OPERATORS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif low == "(":
            if not operand:
                break
            stack.append(low)
            depth += 1
        elif low == ")":
            if operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            if known_only:  # in prose a full stop ends the sentence
                low = low.rstrip(".")
            excepts = stack and stack[-1] == "with"
            if not operand or any(tag in low for tag in EXACT_TAGS) or (in_prose and low in _PROSE):
                break
            if (known_only or in_prose) and not excepts and rank_of(low) == _UNKNOWN:
                after = _TOKEN.search(text, m.end())
                prose = ":" in low or (after is not None and after[0] not in ")/" and after[0].lower() not in _OPERATORS)
                if known_only or (prose and not _ID_FORM.match(low)):
                    break
            if not excepts:
                ids.append(low)
            out.append(low)
            operand = False
        if not operand and not depth:
            best = m.end(), len(out), len(ids), stack[::-1]
    if best is None:
        return None
    end, n_out, n_ids, rest = best
    return text[:end].strip(), " ".join(out[:n_out] + rest), sorted(set(ids[:n_ids]))


def _flat(tree) -> list[str]:
    """The names in a tree of pairs, without recursion, as expressions nest deeply."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x:
            todo.extend(x)
    return out


def evaluate(postfix: str) -> tuple[str, list[str], list[str], float]:
    """Terms, the licences that bind, those that the licensee need not take, and the share of known ones that bind."""
    stack: list[tuple[int, object, object]] = []  # class of terms, names that bind, names passed over
    for token in postfix.split(" "):
        if token not in _OPERATORS:
            stack.append((rank_of(token), token, ()))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "and":
            stack.append((max(left[0], right[0]), (left[1], right[1]), (left[2], right[2])))
        elif token == "or":
            taken, other = (right, left) if right[0] < left[0] else (left, right)
            stack.append((taken[0], taken[1], (taken[2], other[1], other[2])))
        else:
            lighter = left[0] == _STRONG and right[1] in _LINKING
            name = f"{left[1]} with {right[1]}" if isinstance(left[1], str) and isinstance(right[1], str) else (left[1], right[1])
            stack.append((_WEAK if lighter else left[0], name, left[2]))
    rank, binding, passed = stack[0]
    binding = sorted(set(_flat(binding)))
    known = sum(rank_of(b.split(" with ")[0]) != _UNKNOWN for b in binding) / len(binding)
    return _CLASSES[rank], binding, sorted(set(_flat(passed)) - set(binding)), known


def build_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for base, phrases in ((False, NOTICE_PHRASES), (True, BASE_PHRASES)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (len(phrase), label, base))
    found.make_automaton()
    return found


def tag_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for tags, kind in ((EXACT_TAGS, "exact"), (PLAIN_TAGS, "plain"), (ADDRESS_TAGS, "address")):
        for tag in tags:
            found.add_word(tag, (kind, tag))
    found.make_automaton()
    return found


def read_tag(raw: bytes, kind: str, tag: str, end: int, stop: int) -> dict | None:
    """What stands behind a tag that ends at end: an expression, evaluated; it reaches to stop at most."""
    if kind == "address":
        path = _ADDRESS.match(raw, end, stop)
        if not path:
            return None
        name = ADDRESS_TAGS[tag] + re.sub(r"\.(html|txt|php)$", "", path[0].decode("latin-1").lower().replace("/", "-")).rstrip(".-")
        found = (name, name, [name]) if rank_of(name) != _UNKNOWN else None
    else:
        line = _EXPRESSION.match(raw, end, stop)
        found = longest_expression(line[1].decode("latin-1"), kind == "plain", True) if line else None
    if not found:
        return None
    terms, binding, alternatives, known = evaluate(found[1])
    return {"text": found[0], "parsed": found[1], "licences": found[2], "binding": binding, "alternatives": alternatives, "terms": terms, "known": known}


def scan_text(text: str | None, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton):
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_WORD_BYTES).split(b" ")
    words = [w for w in words if w]
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, at, word = [], 0, 0
    for end, (length, label, base) in sorted(phrases.iter(joined), key=lambda m: m[0] - m[1][0]):
        start = end - length  # of the phrase's first character
        word += joined.count(" ", at, start)
        at = start
        places.append({"label": label, "base": base, "word": word - 1})
    low = raw.translate(LOWER).decode("latin-1")
    hits = [(end + 1, kind, tag) for end, (kind, tag) in tags.iter(low)]
    stops = [*(end - len(tag) for end, _, tag in hits[1:]), len(raw)]  # up to the next tag, so that all expressions together are one pass
    expressions = [read_tag(raw, kind, tag, end, max(end, stop)) for (end, kind, tag), stop in zip(hits, stops)]
    return len(words), places, [e for e in expressions if e]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, places (label, base, word: start in words) in text order, expressions.

    An expression has its text, postfix form, all licence ids, those that bind, the alternatives that the licensee need
    not take, the class of its terms, and the share of known ids among those that bind.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tags = build_automaton(), tag_automaton()
        types = out_type
        for batch in batches:
            found = [scan_text(t.as_py(), phrases, tags) for t in batch.column(1)]
            columns = [batch.column(0), *(pa.array([f[k] for f in found], types[k]) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "places", "expressions"])

    place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64())])
    names = pa.list_(pa.string())
    expression = pa.struct([("text", pa.string()), ("parsed", pa.string()), ("licences", names), ("binding", names), ("alternatives", names), ("terms", pa.string()), ("known", pa.float64())])
    out_type = [pa.int64(), pa.list_(place), pa.list_(expression)]
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, {RESULT}")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    binding = F.flatten(F.transform("expressions", lambda e: e["binding"]))
    others = F.transform(F.flatten(F.transform("expressions", lambda e: e["alternatives"])), lambda x: F.concat(F.lit("or:"), x))
    terms = F.transform("expressions", lambda e: F.concat(F.lit("terms:"), e["terms"]))
    kinds = F.size(F.array_distinct(F.transform("places", lambda p: p["label"])))
    known = F.coalesce(F.array_max(F.transform("expressions", lambda e: e["known"])), F.lit(0.0))
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.transform(base, lambda p: p["label"])).alias("base_labels"),
        joined(F.concat(F.transform("places", lambda p: p["label"]), binding, others, terms)).alias("labels"),
        (1 - F.pow(F.lit(1 - PHRASE_WEIGHT), kinds) * (1 - F.lit(TAG_WEIGHT) * known)).alias("score"),
    )
