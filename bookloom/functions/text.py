"""Text functions as column expressions: normal forms, trigram similarity, cleaning rules.

Only Unicode composition needs Python (there is no built-in for it); strings that cannot change under it skip the call.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Strings made of these characters are their own composed form.
_COMPOSED = r"^[\x00-\x7FЀ-҂Ҋ-ӿ]*$"


def let(value: Column, body) -> Column:
    """Evaluate value once and use it in body, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


@F.pandas_udf(StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    plain = c.rlike(_COMPOSED)
    return F.when(plain, c).otherwise(_compose(F.when(~plain, c)))


def fold(c: Column) -> Column:
    """Lower case, ё as е, runs of anything but letters and digits as one blank, trimmed. Null stays null."""
    return F.btrim(F.regexp_replace(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), r"[^\p{L}\p{N}]+", " "))


def normalize(c: Column, composed: bool = False) -> Column:
    """The search form of a title or name; composed: the column is known to be in composed form."""
    return fold(c if composed else nfc(c))


def normalize_text(s: str | None) -> str | None:
    """normalize() of one string, on the driver: for needles."""
    import regex

    if s is None:
        return None
    low = unicodedata.normalize("NFC", s).lower().replace("ё", "е")
    return regex.sub(r"[^\p{L}\p{N}]+", " ", low).strip(" ")


def words(c: Column) -> Column:
    """Non-empty words of a string of letters, digits and anything between."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ordered_trigrams(c: Column) -> Column:
    """Trigrams in order: each word is padded with two blanks before and one after."""
    one = lambda w: let(
        F.concat(F.lit("  "), w, F.lit(" ")), lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))
    )
    return F.flatten(F.transform(words(c), one))


def trigrams(c: Column) -> Column:
    return F.array_distinct(ordered_trigrams(c))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce((both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))).cast("double"), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both strings."""
    return let(trigrams(a), lambda x: let(trigrams(b), lambda y: overlap(x, y)))


def extent_similarity(needle: Column, target: Column) -> Column:
    """The best overlap of needle (distinct trigrams) with any run of target (trigrams in order)."""

    def best(t: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.array_contains(needle, F.get(t, i)))

        def of(i: Column, j: Column) -> Column:
            return let(F.array_distinct(F.slice(t, i + 1, j - i + 1)), lambda e: overlap(needle, e))

        pairs = let(at, lambda a: F.flatten(F.transform(a, lambda i: F.transform(F.filter(a, lambda j: j >= i), lambda j: of(i, j)))))
        return F.when(F.size(t) > 0, F.coalesce(F.array_max(pairs), F.lit(0.0))).otherwise(0.0)

    return let(target, best)


def word_similarity(needle: Column, target: Column) -> Column:
    return let(trigrams(needle), lambda a: extent_similarity(a, ordered_trigrams(target)))


def may_reach(needle: Column, target_set: Column, floor: float) -> Column:
    """Whether extent_similarity can reach floor: a bound that needs no runs."""
    return F.size(F.array_intersect(needle, target_set)) >= floor * F.size(needle)


def covers(given: Column, wanted: Column) -> Column:
    """Every word of wanted starts some word of given."""
    return F.forall(wanted, lambda w: F.exists(given, lambda g: F.startswith(g, w)))


# --- matching of outside lists -------------------------------------------------------------------------------------


def trim_subtitle(c: Column) -> Column:
    """Up to the first colon, then up to the first spaced dash."""
    return F.split(F.split(c, ":", 2)[0], " — ", 2)[0]


def match_form(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one blank. No composition and no folding of ё."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


# --- cleaning ------------------------------------------------------------------------------------------------------


def clean_title(c: Column) -> Column:
    """Strip blanks, quotes, &, -, ., #, backticks and line ends at both ends; collapse white space."""
    return F.regexp_replace(F.btrim(c, F.lit(" \"'&-.\n#`")), r"\s+", " ")


def clean_anchor(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\p{Cc}]", "")


def escape_html(c: Column) -> Column:
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    """Tags become blanks, white space collapses."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))


def leading_int(c: Column) -> Column:
    """The whole number at the start of a string, else 0."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def capitalize_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def author_title(c: Column) -> tuple[Column, Column]:
    """Author and title around the first separator, in fixed order, that leaves text on both sides; else no author."""
    #: Fixed values, in order of precedence.
    separators = [": ", " - ", " — ", ":", "-", "—"]
    author, title = F.lit(""), F.btrim(c)
    for s in reversed(separators):
        at = F.instr(c, s)
        left, right = F.btrim(F.substring(c, F.lit(1), at - 1)), F.btrim(F.substring(c, at + len(s), F.lit(1 << 30)))
        hit = (at > 0) & (left != "") & (right != "")
        author, title = F.when(hit, left).otherwise(author), F.when(hit, right).otherwise(title)
    return author, title


#: Letters of the Russian alphabet and how they are written in Latin.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "jo", "ж": "zh", "з": "z", "и": "i", "й": "j",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "shh", "ъ": "", "ы": "y", "ь": "", "э": "je", "ю": "ju", "я": "ja",
}


def transliterate(c: Column, table: dict[str, str] | None = None) -> Column:
    """Letter by letter; a capital letter gives a capital first letter."""
    table = table or LATIN
    both = table | {a.upper(): b[:1].upper() + b[1:] for a, b in table.items()}
    known = F.create_map(*[F.lit(x) for pair in both.items() for x in pair])
    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(known, ch), ch)), "")


def download_name(title: Column) -> Column:
    """The file name of a title: runs of anything but Latin and Cyrillic letters and digits as one underscore, in Latin letters, lower case."""
    return F.lower(transliterate(F.regexp_replace(title, "[^A-Za-z0-9а-яА-ЯёЁ]+", "_")))


def shouting(c: Column) -> Column:
    """At least four letters, and either capitals only or four in five of them capitals."""
    letters, upper, lower = (F.regexp_count(c, F.lit(p)) for p in (r"\p{L}", r"\p{Lu}", r"\p{Ll}"))
    return (letters >= 4) & (((lower == 0) & (upper > 0)) | (100 * upper >= 80 * letters))


def repair_case(c: Column) -> Column:
    """Shouted names word by word in title case; abbreviations of up to three letters and Roman numerals stay capital."""
    edge = r"^([^\p{L}\p{Nd}]*)(.*?)([^\p{L}\p{Nd}]*)$"

    def word(w: Column) -> Column:
        lead, core, tail = (F.regexp_extract(w, edge, k) for k in (1, 2, 3))
        stays = F.btrim(core, F.lit(".")).rlike(r"^[\p{L}&&[^\p{Ll}]]{1,3}$") | core.rlike(r"^[IVXLCDM]+$")
        return F.concat(lead, F.when(stays, F.upper(core)).otherwise(F.concat(F.upper(F.substring(core, 1, 1)), F.lower(F.substring(core, 2, 1 << 30)))), tail)

    name = F.btrim(c)
    return F.when(shouting(name), F.array_join(F.transform(F.split(name, r"\s+"), word), " ")).otherwise(name)
