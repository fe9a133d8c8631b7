"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes in both directions, labels every byte, and a document's probabilities are
the mean over all bytes of all its windows; whole texts are read. It is trained in numpy by backpropagation through
time on the driver, from a bounded sample: PER_LANG documents of each language at most (the least by hash in each of
PER_LANG hash buckets), WINDOWS windows of each. Only documents outside the held-out fold with a language are learned
from; prediction sees the text alone, and the weights (a few kB) travel with the tasks.

Defined cases: `und` with score 0 for a null text, one without a letter, or when there is nothing to learn from; a
null doc_id counts as empty text in the fold rule; repeated rows get equal results; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import small_batches, text_steps

WINDOW, HIDDEN = 64, 8
PER_LANG, WINDOWS = 256, 4
EPOCHS, BATCH, RATE, SEED = 10, 256, 0.02, 7
#: Windows that one step of a task runs through the network together.
TOGETHER = 8192
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


@dataclass
class Direction:
    """One gated recurrent unit: input weights by byte (3H x 256) and recurrent weights (3H x H), for update, reset, candidate."""

    by_byte: np.ndarray
    recur: np.ndarray

    def states(self, x: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """The state after each step; x is steps x windows of bytes. keep collects what backward() needs."""
        size = self.recur.shape[1]
        h = np.zeros((size, x.shape[1]), np.float32)
        for row in x:
            given = np.take(self.by_byte, row, axis=1)
            told = self.recur @ h
            gates = _sigmoid(np.clip(given[: 2 * size] + told[: 2 * size], -30, 30))
            z, r = gates[:size], gates[size:]
            n = np.tanh(given[2 * size :] + r * told[2 * size :])
            before, h = h, n + z * (h - n)
            if keep is not None:
                keep.append((before, z, r, n, told[2 * size :]))
            yield h

    def backward(self, x: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Through time: gradients of by_byte and recur from those of the states (steps x H x windows)."""
        d_recur = np.zeros_like(self.recur)
        d_given = np.empty((len(x), *self.by_byte.shape[:1], x.shape[1]), np.float32)
        d = np.zeros_like(d_states[0])
        for t in range(len(x) - 1, -1, -1):
            before, z, r, n, told = kept[t]
            d = d + d_states[t]
            dz = d * (before - n) * z * (1 - z)
            dn = d * (1 - z) * (1 - n * n)
            dr = dn * told * r * (1 - r)
            gates = np.concatenate([dz, dr, dn * r])
            d_given[t] = np.concatenate([dz, dr, dn])
            d_recur += gates @ before.T
            d = d * z + self.recur.T @ gates
        flat = x.ravel()
        d_by_byte = np.stack([np.bincount(flat, weights=d_given[:, k].ravel(), minlength=256) for k in range(len(self.by_byte))])
        return d_by_byte.astype(np.float32), d_recur


@dataclass
class Network:
    langs: list[str]
    forth: Direction
    back: Direction
    out: np.ndarray  # langs x 2H
    bias: np.ndarray  # langs x 1

    @classmethod
    def new(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
        draw = lambda *shape: (rng.normal(0, 0.3, shape)).astype(np.float32)
        one = lambda: Direction(draw(3 * hidden, 256), draw(3 * hidden, hidden))
        return cls(langs, one(), one(), draw(len(langs), 2 * hidden), np.zeros((len(langs), 1), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.forth.by_byte, self.forth.recur, self.back.by_byte, self.back.recur, self.out, self.bias]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of every language at every byte: steps x langs x windows, for windows x steps of bytes."""
        x = np.ascontiguousarray(windows.T)
        size = self.forth.recur.shape[1]
        logits = np.empty((len(x), len(self.langs), x.shape[1]), np.float32)
        for t, h in enumerate(self.forth.states(x)):
            np.matmul(self.out[:, :size], h, out=logits[t])
        for t, h in enumerate(self.back.states(x[::-1])):
            logits[-1 - t] += self.out[:, size:] @ h
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over all bytes of windows, whose languages are labels."""
        x = np.ascontiguousarray(windows.T)
        size = self.forth.recur.shape[1]
        kept: tuple[list, list] = ([], [])
        forth = np.stack(list(self.forth.states(x, kept[0])))
        back = np.stack(list(self.back.states(x[::-1], kept[1])))[::-1]
        both = np.concatenate([forth, back], axis=1)
        d = np.einsum("kh,thb->tkb", self.out, both) + self.bias
        d = np.exp(d - d.max(axis=1, keepdims=True))
        d /= d.sum(axis=1, keepdims=True)
        d[:, labels, np.arange(len(labels))] -= 1
        d /= np.float32(d.shape[0] * d.shape[2])
        d_out = np.einsum("tkb,thb->kh", d, both)
        d_states = np.einsum("kh,tkb->thb", self.out, d)
        first = self.forth.backward(x, kept[0], d_states[:, :size])
        second = self.back.backward(x[::-1], kept[1], d_states[::-1, size:])
        return [*first, *second, d_out, d.sum(axis=(0, 2))[:, None]]


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Adam over shuffled batches; the same input gives the same network."""
    rng = np.random.default_rng(SEED)
    net = Network.new(langs, hidden, rng)
    mean, square = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            step += 1
            pick = order[at : at + BATCH]
            rate = RATE * (0.5 if epoch >= epochs // 2 else 1.0)
            for w, m, s, g in zip(net.weights(), mean, square, net.gradients(windows[pick], labels[pick])):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of whole texts (the last one filled up with blanks), how many each text has, and each window's own bytes."""
    many = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    filled = b"".join(t + b" " * (-len(t) % WINDOW) for t in texts)
    own = np.full(int(many.sum()), WINDOW, np.int64)
    ends = np.cumsum(many)[many > 0] - 1
    own[ends] -= np.array([-len(t) % WINDOW for t, m in zip(texts, many) if m], np.int64)
    return np.frombuffer(filled, np.uint8).reshape(-1, WINDOW), many, own


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all bytes of each text: texts x langs; zeros for an empty text."""
    windows, many, own = cut_windows(texts)
    sums = np.zeros((len(windows), len(net.langs)))
    for at in range(0, len(windows), TOGETHER):
        p = net.probabilities(windows[at : at + TOGETHER])
        for w in np.flatnonzero(own[at : at + TOGETHER] < WINDOW):
            p[own[at + w] :, :, w] = 0
        sums[at : at + TOGETHER] = p.sum(axis=0).T
    total = np.zeros((len(texts), len(net.langs)))
    np.add.at(total, np.repeat(np.arange(len(texts)), many), sums)
    return total / np.maximum(np.array([len(t) for t in texts]), 1)[:, None]


def spans(net: Network, text: bytes) -> list[tuple[int, int, str]]:
    """The label of every byte, as runs (start, end, language)."""
    if not text:
        return []
    windows, _, _ = cut_windows([text])
    label = net.probabilities(windows).argmax(axis=1).T.ravel()[: len(text)]
    cut = np.flatnonzero(np.diff(label)) + 1
    return [(int(a), int(b), net.langs[label[a]]) for a, b in zip([0, *cut], [*cut, len(text)])]


def training_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The bounded sample of docs (doc_id, text, lang): windows, labels, languages."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("id"))
    chosen = known.groupBy("lang", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(PER_LANG)).alias("bucket")).agg(F.min(order).alias("first"))
    ids = sorted({r["first"]["id"] for r in chosen.select("first").collect()})  # PER_LANG for each language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                windows = cut_windows([text.encode("utf-8", "surrogatepass")])[0]
                if len(windows):
                    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                    pick = rng.permutation(len(windows))[:WINDOWS]
                    out.append({"lang": name, "windows": windows[np.sort(pick)].tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), ("windows", pa.binary())]))

    rows = known.where(F.col("doc_id").isin(ids)).select("lang", "text").mapInArrow(run, "lang string, windows binary").collect() if ids else []
    rows = sorted((r["lang"], bytes(r["windows"])) for r in rows)
    langs = sorted({r[0] for r in rows})
    windows = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    labels = np.repeat([langs.index(r[0]) for r in rows], [len(r[1]) // WINDOW for r in rows]).astype(np.int64) if rows else np.empty(0, np.int64)
    return windows, labels, langs


def fit(docs: DataFrame) -> Network | None:
    windows, labels, langs = training_windows(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    return train(windows, labels, langs) if len(labels) else None


def predict(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """keep, lang_pred, score, and with_spans also spans array<struct<start, stop, lang>> over the text's UTF-8 bytes.

    Of languages with equal pooled probabilities the first in order of name wins.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    readable = F.when(text.rlike(r"\p{L}"), text) if net else F.lit(None).cast("string")
    rows = docs.select(*keep, readable.alias("_text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in text_steps(texts):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts.slice(a, b - a).to_pylist()]
                p = pooled(net, raw) if net else np.zeros((b - a, 1))
                best = p.argmax(axis=1)
                lang = [net.langs[k] if t else UNKNOWN for k, t in zip(best, raw)]
                score = np.where([bool(t) for t in raw], p.max(axis=1), 0.0).clip(0, 1)
                columns = [*(batch.column(k).slice(a, b - a) for k in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                if with_spans:
                    columns.append(pa.array([[dict(zip(("start", "stop", "lang"), s)) for s in spans(net, t)] if t else [] for t in raw], span))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [*keep, "lang_pred", "score", *["spans"] * with_spans]
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double" + ", spans array<struct<start:long,stop:long,lang:string>>" * with_spans)


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
