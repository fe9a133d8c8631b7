"""Small record functions: names shown, paths, keys, answers of outside services, validity of accounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an e-mail address and a login look like, and how short a password may be.
EMAIL = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"
LOGIN, LEAST_PASSWORD = r"^[a-zA-Z0-9_-]+$", 8
#: Commands and the kind of search that each asks for.
COMMANDS = {"find_book": "title_only", "find_author": "author_only", "find_book_with_author": "combined"}


def display_name(title: Column, genre: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), genre)


def cover_path(book_path: Column, file_name: Column) -> Column:
    """Relative path of a cover: dots become dashes, the file ends in .jpg."""
    folder = F.replace(F.regexp_replace(book_path, r"^[/\\]+", ""), F.lit("."), F.lit("-"))
    return F.regexp_replace(F.concat(folder, F.lit("/"), F.replace(file_name, F.lit("."), F.lit("-")), F.lit(".jpg")), "^/+", "")


def revision_key(*parts: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of the parts with NUL between them."""
    return F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, 16)


def json_part(answer: Column) -> Column:
    """From the first { to the last } of an answer, null if there is none."""
    return F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))


def command_of(answer: Column) -> Column:
    """struct<command, title, author, search_type> of an answer; what does not parse or lacks its terms is unknown."""
    schema = "command string, title string, author string"
    parsed = F.coalesce(F.from_json(answer, schema)["command"], F.lit("")) != ""
    raw = F.when(parsed, F.from_json(answer, schema)).otherwise(F.from_json(json_part(answer), schema))
    clean = lambda c: F.coalesce(F.btrim(raw[c]), F.lit(""))
    name, title, author = F.lower(clean("command")), F.lower(clean("title")), clean("author")
    ok = ((name == "find_book") & (title != "")) | ((name == "find_author") & (author != "")) | ((name == "find_book_with_author") & ((title != "") | (author != "")))
    kinds = F.create_map(*[F.lit(x) for pair in COMMANDS.items() for x in pair])
    given = lambda c: F.when(ok, c).otherwise("")
    return F.struct(
        F.when(ok, name).otherwise("unknown").alias("command"), given(title).alias("title"), given(author).alias("author"), F.when(ok, F.element_at(kinds, name)).otherwise("").alias("search_type")
    )


def valid_account(email: Column, login: Column, password: Column) -> Column:
    return email.rlike(EMAIL) & login.rlike(LOGIN) & (F.octet_length(password) >= LEAST_PASSWORD)


#: The types of the events that long jobs send.
EVENT_TYPES = [
    "scan_started", "archive_started", "book_processed", "archive_completed", "scan_completed", "scan_error", "scan_progress",
    "fix_scan_started", "fix_scan_progress", "fix_scan_completed", "fix_scan_error",
    "genre_title_gen_started", "genre_title_gen_progress", "genre_title_gen_completed",
]


def event_job(event_type: Column) -> Column:
    """The job that an event belongs to (scan, fix_scan, genre_title_gen); null for a type that is not known."""
    job = F.when(F.startswith(event_type, F.lit("fix_scan")), "fix_scan").when(F.startswith(event_type, F.lit("genre_title_gen")), "genre_title_gen").otherwise("scan")
    return F.when(event_type.isin(EVENT_TYPES), job)


def event_ends(event_type: Column) -> Column:
    """Whether an event is the last of its job."""
    return event_type.isin("scan_completed", "fix_scan_completed", "genre_title_gen_completed")
