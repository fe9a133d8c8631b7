"""Best-fit packing of documents into token sequences, planned over a histogram of lengths.

Tokens are made once, in vectorised steps; every piece knows its length and its block, by a hash of its row. Best fit runs on
the driver over counts by length (at most one count for each length up to the capacity), never over documents: it
yields slots, ranges of ranks within a length that go to ranges of sequences. A piece's rank within its length is its
row number within (length, block) plus the number of pieces of that length in earlier blocks, so no length, however
common, meets in one task. Pieces take their slots by joining on length and rank.

Defined cases: a null or empty text is the single token 0; repeated rows are packed each for itself; which of several
pieces of one length takes which place is not promised, but offsets and sequences are gapless and whole; an empty
table gives no rows; other columns are ignored unless asked for.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookloom.llm.common import free_name, free_prefix, mix64, small_batches, text_steps, written

CAPACITY = 2048
END_ID = 0
#: Bits of an id in packed form.
ID_BITS = 16
#: Bytes of text that are encoded together.
STEP_BYTES = 1 << 19
#: Pieces of words that a worker remembers at most before it starts anew.
MEMORY = 400_000
#: Pieces in a block of ranks, about.
BLOCK_PIECES = 1 << 20
TOKENIZER = "byte_bpe_50k.json"
#: Tokens in a reading block, about, and the seed by which sequences are dealt to them.
BLOCK_TOKENS, READING_SEED = 1 << 20, 29
RESULTS = ["piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]


@lru_cache(maxsize=2)
def _classes(path: str) -> np.ndarray:
    """The class of each code point in the splitting pattern: 0 other, 1 letter, 2 number, 3 white space.

    They are the library's own, whatever Unicode tables it has: a run of code points that makes one piece with `!`, a
    letter or a digit in front is of that class; other runs are halved. What makes a piece with none is white space.
    """
    from tokenizers import Tokenizer

    splitter = Tokenizer.from_file(path).pre_tokenizer
    out = np.zeros(0x110000, np.uint8)
    runs = [(0, 0xD800), *((lo, lo + 0x2000) for lo in range(0xE000, 0x110000, 0x2000))]  # surrogates stay 0: no text has them
    while runs:
        lo, hi = runs.pop()
        text = "".join(map(chr, range(lo, hi)))
        kind = next((k for k, front in enumerate("!a1") if len(splitter.pre_tokenize_str(front + text)) == 1), 3 if hi - lo == 1 else None)
        if kind is None:
            runs += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
        else:
            out[lo:hi] = kind
    return out


def piece_starts(cp: np.ndarray, kind: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where the tokenizer's splitting pattern starts a piece, over the code points of many texts (doc_start: of each text).

    The pattern: contractions, then an optional blank and a run of one class, and of a run of white space all but the
    last character, which goes to the next word if it is a blank.
    """
    n = len(cp)
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change[doc_start[doc_start < n]] = True
    start = change.copy()
    space = kind == 3
    run_end = np.empty(n, bool)  # the last character of its run
    run_end[-1] = True
    run_end[:-1] = change[1:]
    text_end = np.zeros(n, bool)
    text_end[-1] = True
    later = doc_start[(doc_start > 0) & (doc_start < n)]
    text_end[later - 1] = True
    tail = space & run_end & ~text_end  # white space before a word
    start |= tail
    blank = tail & (cp == 32)
    start[1:][blank[:-1]] = False  # the blank and the word are one piece
    quote = np.flatnonzero((cp[:-1] == 39) & start[:-1] & (kind[1:] == 1) & ~text_end[:-1]) if n > 1 else np.empty(0, np.int64)
    for i in quote:  # a contraction ends after its letters
        a = cp[i + 1]
        if a in (115, 116, 109, 100):
            size = 2
        elif i + 2 < n and not text_end[i + 1] and (a, cp[i + 2]) in ((114, 101), (118, 101), (108, 108)):
            size = 3
        else:
            continue
        start[i + 1 : i + size] = False
        if i + size < n:
            start[i + size] = True
    return start


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE file as bytes to ids; None unless ids follow the order of the merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file shows as themselves
    as_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)) or any(vocab.get(c, 256) > 255 for c in as_byte):
        return None
    return {bytes(as_byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}


class PieceTokenizer:
    """Ids of texts, as the tokenizers library gives them; every distinct piece of a step is encoded once.

    Where the ids of the file follow its merges, its vocabulary runs in a faster merger, which gives the same ids. A
    text that holds a control string of the file goes through the library whole; as_text makes it ordinary text.
    """

    def __init__(self, path: str, as_text: bool = False, classes: bytes | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks already use all cores
        self.path, self.library, self.merger, self.as_text = path, None, None, as_text
        with open(path, encoding="utf-8") as f:
            self.control = [] if as_text else [t["content"] for t in json.load(f).get("added_tokens", [])]
        ranks = byte_ranks(path)
        if ranks:  # the same merges, faster on words that are new
            import tiktoken

            self.merger = tiktoken.Encoding("merges", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={})
            self.separator = ranks[b"\0"]
        self.classes = _classes(path) if classes is None else np.frombuffer(zlib.decompress(classes), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # hashes in order
        self.place = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = self.as_text
        return [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode pieces: together with NUL between them where the ids follow the merges, by the library else."""
        if len(self.known) and len(self.known) + len(hashes) > MEMORY:
            raise MemoryError
        alone = np.fromiter((self.merger is None or "\0" in p for p in pieces), bool, len(pieces))
        joined, single = np.flatnonzero(~alone), np.flatnonzero(alone)
        size = np.zeros(len(pieces), np.int64)
        parts = []
        for at in range(0, len(joined), 5000):
            ids = np.asarray(self.merger.encode_ordinary("".join(pieces[i] + "\0" for i in joined[at : at + 5000])), np.int32)
            end = ids == self.separator
            size[joined[at : at + 5000]] = np.diff(np.flatnonzero(end), prepend=-1) - 1
            parts.append(ids[~end])
        for i, ids in zip(single, self._ids([pieces[i] for i in single]) if len(single) else []):
            size[i] = len(ids)
            parts.append(np.asarray(ids, np.int32))
        order = np.concatenate([joined, single])
        place = np.empty(len(pieces), np.int64)
        place[order] = len(self.pool) + np.cumsum(size[order]) - size[order]
        self.pool = np.concatenate([self.pool, *parts])
        at = np.searchsorted(self.known, hashes)  # hashes come in order
        self.known, self.place, self.size = np.insert(self.known, at, hashes), np.insert(self.place, at, place), np.insert(self.size, at, size)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts one after another, and how many each text has."""
        apart = [i for i, t in enumerate(texts) if any(c in t for c in self.control)]
        if not apart:
            return self._encode_plain(texts)
        held = set(apart)
        ids, counts = self._encode_plain(["" if i in held else t for i, t in enumerate(texts)])
        whole = dict(zip(apart, self._ids([texts[i] for i in apart])))
        ends = np.cumsum(counts)
        parts = [np.asarray(whole[i], np.int32) if i in held else ids[e - n : e] for i, (e, n) in enumerate(zip(ends, counts))]
        counts[apart] = [len(whole[i]) for i in apart]
        return np.concatenate(parts), counts

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        doc_start = np.cumsum(lengths) - lengths
        starts = np.flatnonzero(piece_starts(cp, self.classes[cp], doc_start))
        ends = np.append(starts[1:], len(cp))
        with np.errstate(over="ignore"):
            place = np.arange(len(cp), dtype=np.uint64) - np.repeat(starts, ends - starts).astype(np.uint64)
            each = mix64(cp.astype(np.uint64) + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            hashes = mix64(np.add.reduceat(each, starts) + (ends - starts).astype(np.uint64))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        for _ in range(2):
            at = np.searchsorted(self.known, distinct)
            new = np.ones(len(distinct), bool)
            inside = at < len(self.known)
            new[inside] = self.known[at[inside]] != distinct[inside]
            if not new.any():
                break
            try:
                self._learn(distinct[new], [joined[starts[i] : ends[i]] for i in first[new]])
            except MemoryError:
                self.forget()
                self._learn(distinct, [joined[starts[i] : ends[i]] for i in first])
        at = np.searchsorted(self.known, distinct)
        size = self.size[at][which]
        base = np.repeat(self.place[at][which] - (np.cumsum(size) - size), size)
        ids = self.pool[base + np.arange(len(base))]
        per_piece_doc = np.searchsorted(doc_start, starts, side="right") - 1
        # texts of no length share a start with the next one: the last of them owns the pieces, as side="right" has it
        counts = np.bincount(per_piece_doc, weights=size, minlength=len(texts)).astype(np.int64)
        return ids, counts


@lru_cache(maxsize=2)
def piece_tokenizer(path: str, as_text: bool = False, classes: bytes | None = None) -> PieceTokenizer:
    return PieceTokenizer(path, as_text, classes)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def token_pieces(docs: DataFrame, keep: list[str], tokenizer: str | None = None, capacity: int = CAPACITY, text_col: str = "text", form: str = "ids", as_text: bool = False) -> DataFrame:
    """keep, piece, start, length, ids: a document's ids and END_ID, cut only if longer than capacity.

    Of a longer document the first piece may be shorter. The form of ids: `ids` array<int>; `packed` binary, little-endian
    and unsigned with ID_BITS bits each, which is half as large to move; `crc32` ids_crc32 (over 32-bit ids) in their
    place, so that they never leave the Python worker. Control strings of the tokenizer's file that stand in a text
    get their ids, as the library has it; as_text makes them ordinary text.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    classes = zlib.compress(_classes(path).tobytes())  # a few KB, worked out once and not by every worker
    last, kind = {"ids": ("ids", "array<int>"), "packed": ("ids", "binary"), "crc32": ("ids_crc32", "long")}[form]
    held = [free_name(k, [*RESULTS, last]) for k in keep]
    rows = docs.select(*[F.col(f"`{k}`").alias(h) for k, h in zip(keep, held)], F.col(f"`{text_col}`").cast("string"))
    names = [*held, "piece", "start", "length", last]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_tokenizer(path, as_text, classes)
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in text_steps(texts, STEP_BYTES):
                ids, counts = own.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                total = counts + 1
                whole = np.full(int(total.sum()), END_ID, np.int32)
                mask = np.ones(len(whole), bool)
                mask[np.cumsum(total) - 1] = False
                whole[mask] = ids
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                short = total - (pieces - 1) * capacity  # of the first piece
                length = np.where(piece == 0, short[doc], capacity)
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                ends = np.concatenate([[0], np.cumsum(length)])
                if form == "crc32":
                    data = whole.astype("<u4", copy=False)
                    made = pa.array([zlib.crc32(data[x:y]) for x, y in zip(ends[:-1], ends[1:])], pa.int64())
                elif form == "packed":
                    if len(whole) and whole.max() >> ID_BITS:
                        raise ValueError(f"ids of this tokenizer need more than {ID_BITS} bits")
                    data = whole.astype("<u2")
                    made = pa.array([data[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])], pa.binary())
                else:
                    made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(whole))
                held = [batch.column(k).slice(a, b - a).take(pa.array(doc)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*held, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), made], names)
        own.forget()  # an idle worker keeps no words

    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kept}, piece int, start long, length long, {last} {kind}")


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: slots (length, rank, sequences, each, sequence, offset).

    Pieces of this length with ranks from rank on fill sequences of them, `each` per sequence, from number `sequence`
    on and from `offset` on within each. Open sequences are groups of neighbours with equal room, so the work follows
    the number of groups: a group is cut in two by each length at most, and takes at most 63 distinct lengths at a
    capacity of 2048.
    """
    slots = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left: groups (first sequence, how many)
    rooms: list[int] = []  # in order
    following = 0

    def put(left: int, first: int, many: int) -> None:
        if left and many:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, many))

    for length in sorted(counts, reverse=True):
        rest, rank = counts[length], 0
        while rest:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, many = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first = capacity, following
                many = -(-rest // (capacity // length))
                following += many
            each = left // length
            full = min(many, rest // each)
            if full:
                slots.append((length, rank, full, each, first, capacity - left))
                put(left - each * length, first, full)
                rest, rank = rest - full * each, rank + full * each
            if full < many and rest and rest < each:
                slots.append((length, rank, 1, rest, first + full, capacity - left))
                put(left - rest * length, first + full, 1)
                rank, full, rest = rank + rest, full + 1, 0
            put(left, first + full, many - full)
    return slots


def assign(pieces: DataFrame, row: str, capacity: int = CAPACITY, block_tokens: int | None = None) -> DataFrame:
    """pieces but their row, plus sequence_id and offset. pieces is read several times and should be written.

    row is a hash by which pieces of one length are ranked, in blocks whose number grows with that of the pieces.
    With block_tokens also block and key (underscores after the names where pieces has them): sequences are dealt by hash to reading blocks of about so many tokens, to be
    read in turn and each in order of key. Pieces of any length come to sequences by hash too, so every block holds
    every source by its share of what is packed.
    """
    spark, p = pieces.sparkSession, free_prefix("_s_", pieces.columns)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pieces.count() // BLOCK_PIECES))
    block = f"{p}at"
    pieces = pieces.withColumn(block, F.pmod(F.col(row), F.lit(blocks)).cast("int"))
    part = pieces.select("length", F.col(block).alias(f"{p}block"))
    by_block = part.groupBy("length", f"{p}block").agg(F.count("*").alias(f"{p}n"))
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum(f"{p}n").alias("n")).collect()}  # at most capacity rows
    slots = spark.createDataFrame(best_fit_plan(counts, capacity), "length long, rank long, many long, each long, first long, at long")
    before = Window.partitionBy("length").orderBy(f"{p}block").rowsBetween(Window.unboundedPreceding, -1)
    base = by_block.select(F.col("length").alias(f"{p}length"), f"{p}block", F.coalesce(F.sum(f"{p}n").over(before), F.lit(0)).alias(f"{p}base"))
    inside = Window.partitionBy("length", block).orderBy(row)
    ranked = pieces.withColumn(f"{p}row", F.row_number().over(inside) - 1)
    ranked = ranked.join(base, (ranked["length"] == base[f"{p}length"]) & (ranked[block] == base[f"{p}block"]))
    rank, slot = F.col(f"{p}row") + F.col(f"{p}base"), F.col(f"{p}slot")
    slots = slots.select(F.struct("*").alias(f"{p}slot"))
    hit = (F.col("length") == slot["length"]) & (rank >= slot["rank"]) & (rank < slot["rank"] + slot["many"] * slot["each"])
    place = rank - slot["rank"]
    placed = ranked.join(F.broadcast(slots), hit).select(
        *[F.col(f"`{c}`") for c in pieces.columns if c not in (row, block)],
        (slot["first"] + F.floor(place / slot["each"])).cast("long").alias("sequence_id"),
        (slot["at"] + (place % slot["each"]) * F.col("length")).cast("long").alias("offset"),
    )
    if block_tokens is None:
        return placed
    reading = max(1, -(-sum(n * k for n, k in counts.items()) // block_tokens))
    key = F.xxhash64("sequence_id", F.lit(READING_SEED))
    block = F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * reading, 32)
    return placed.select("*", block.alias(free_name("block", placed.columns)), key.alias(free_name("key", placed.columns)))


def packed(docs: DataFrame, keep: list[str], tokenizer: str | None = None, form: str = "ids", as_text: bool = False, block_tokens: int | None = None) -> DataFrame:
    """keep, piece, start, length, ids (in the form asked for), sequence_id, offset, and on demand block and key: a row per piece.

    Pieces of one length are alike for the plan. They are ranked by a hash of their row, so that copies of a document,
    which stand side by side after mixing, go to sequences far apart. A column in keep that has the name of a
    result column gets underscores after its name.
    """
    pieces = token_pieces(docs, keep, tokenizer, form=form, as_text=as_text)
    row = free_name("row", pieces.columns)
    return assign(written(pieces.withColumn(row, F.xxhash64(F.monotonically_increasing_id())), "pieces"), row, block_tokens=block_tokens)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], form="crc32")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document as packed pieces, 16 bits an id, with the block and key of their sequence.

    A control string in a text is ordinary text here. Reading the blocks in turn, each in order of key, is the mixture
    as training sees it: how often a document is read was decided by the stage before.
    """
    return packed(docs, ["doc_id"], form="packed", as_text=True, block_tokens=BLOCK_TOKENS)
