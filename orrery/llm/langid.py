"""Language identification by a byte convolutional network, trained and applied in numpy.

Texts are cut into windows of ``WIDTH`` bytes.  Bytes are embedded, filters of several widths slide over
them, each filter keeps its maximum, and a softmax layer reads those maxima.  Every window of the whole
text is classified; a text's prediction is the mean of its windows' probabilities, weighted by bytes.

Training reads a bounded sample (``SAMPLE`` labelled texts, two windows of each, at places that depend on
the text's id): the bound is this documented parameter, the rows are those with the smallest hashes.
Prediction reads texts only: no language, source or id.

Defined results: null text, or text without a letter: ``und`` with score 0; texts of any length are read
whole; rows with null lang are not learned from; without any labelled row every text is ``und``; repeated
rows are predicted one by one; languages of equal probability: the first by name; an empty table gives an
empty result; columns of any name are kept by ``predict`` and ``filter_language``, ``identify`` ignores them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import textblocks as tb
from orrery.llm.runtime import arrow_limits, hashed_sample

WIDTH, DIM, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4, 5)
SAMPLE, EPOCHS, STEP, BATCH = 4000, 8, 0.01, 64
UNKNOWN = "und"


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 7) -> ByteCnn:
        r = np.random.default_rng(seed)
        f = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        hidden = FILTERS * len(WIDTHS)
        return cls(langs, f(256, DIM, s=0.5), [f(w * DIM, FILTERS, s=(w * DIM) ** -0.5) for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32) for _ in WIDTHS], f(hidden, len(langs), s=hidden**-0.5), np.zeros(len(langs), np.float32))

    def hidden(self, x: np.ndarray, trace: bool = False):
        """Max-pooled filter outputs of windows x (n, WIDTH) of bytes; with ``trace``, the places of the maxima."""
        e = self.embed[x]
        parts, places = [], []
        for w, k, s in zip(WIDTHS, self.kernels, self.shifts):
            view = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), w * DIM, axis=1)[:, ::DIM]
            z = view.reshape(-1, w * DIM) @ k
            z = z.reshape(len(x), WIDTH - w + 1, FILTERS)
            if trace:
                at = z.argmax(1)
                places.append(at)
                z = np.take_along_axis(z, at[:, None], 1)[:, 0]
            else:
                z = z.max(1)
            parts.append(np.maximum(z + s, 0))
        return (np.concatenate(parts, 1), places) if trace else np.concatenate(parts, 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(x) @ self.out + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels, *self.shifts, self.out, self.bias]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean cross-entropy by each of ``weights``; only the positions of the maxima take part."""
        h, places = self.hidden(x, trace=True)
        z = h @ self.out + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(x)), y] -= 1
        p /= len(x)
        dh = (p @ self.out.T) * (h > 0)
        d_embed, d_kernels, d_shifts = np.zeros_like(self.embed), [], []
        for j, (w, k, at) in enumerate(zip(WIDTHS, self.kernels, places)):
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            symbols = np.take_along_axis(x[:, None, :], at[:, :, None] + np.arange(w), 2)  # n, filters, w
            patch = self.embed[symbols].reshape(len(x), FILTERS, w * DIM)
            d_kernels.append(np.einsum("nf,nfk->kf", d, patch))
            d_shifts.append(d.sum(0))
            np.add.at(d_embed, symbols.reshape(-1), (d[:, :, None] * k.T[None]).reshape(-1, DIM))
        return [d_embed, *d_kernels, *d_shifts, h.T @ p, p.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ByteCnn:
        """Adam on cross-entropy."""
        r = np.random.default_rng(seed)
        first, second, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), BATCH):
                own = order[i : i + BATCH]
                t += 1
                for w, g, m, v in zip(self.weights, self.gradient(x[own], y[own]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= (STEP / (1 + t / 400) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def window_matrix(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes in each) of all texts; the last window of a text is padded with 0."""
    size = np.diff(off)
    n = -(-size // WIDTH)
    doc = np.repeat(np.arange(len(size)), n)
    start = off[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WIDTH
    real = np.minimum(WIDTH, off[1:][doc] - start)
    at = start[:, None] + np.arange(WIDTH)
    x = np.concatenate([data, np.zeros(WIDTH, np.uint8)])[at] if len(doc) else np.zeros((0, WIDTH), np.uint8)
    x[np.arange(WIDTH) >= real[:, None]] = 0
    return x, doc, real


def classify(model: ByteCnn, texts: pa.Array) -> np.ndarray:
    """Mean probabilities (texts, languages); zeros for an empty text."""
    data, off = tb.buffers(texts)
    x, doc, real = window_matrix(data, off)
    out = np.zeros((len(texts), len(model.langs)))
    for i in range(0, len(x), 512):
        np.add.at(out, doc[i : i + 512], model.probabilities(x[i : i + 512]) * real[i : i + 512, None])
    return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def training_windows(labelled: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(windows, label numbers, labels): two windows of each of at most ``sample`` rows (doc_id, text, lang)."""
    size = F.octet_length("text")
    piece = lambda salt: F.substring(F.encode("text", "UTF-8"), F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.greatest(size - WIDTH, F.lit(0)) + 1).cast("int") + 1, F.lit(WIDTH))
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND octet_length(text) > 0")
    short = usable.select(F.xxhash64("doc_id", "text").alias("k"), "lang", piece(1).alias("a"), piece(2).alias("b"))
    rows = hashed_sample(short, sample, "k", "lang", "a").collect()
    langs = sorted({r.lang for r in rows})
    x, y = np.zeros((2 * len(rows), WIDTH), np.uint8), np.zeros(2 * len(rows), np.int64)
    for i, r in enumerate(rows):
        for j, raw in enumerate((r.a, r.b)):
            x[2 * i + j, : len(raw)] = np.frombuffer(raw, np.uint8)
            y[2 * i + j] = langs.index(r.lang)
    return x, y, langs


def fit(labelled: DataFrame, sample: int = SAMPLE) -> ByteCnn | None:
    x, y, langs = training_windows(labelled, sample)
    return ByteCnn.fresh(langs).train(x, y) if len(langs) else None


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, made longer until no column has that name (names are compared as Spark does, without case)."""
    held = {c.lower() for c in columns}
    while wanted.lower() in held:
        wanted += "_"
    return wanted


def predict(docs: DataFrame, model: ByteCnn | None, text: str = "text") -> tuple[Column, DataFrame]:
    """``docs`` with a further struct column (lang_pred, score), and that column; its name is one that ``docs`` lacks."""
    spark = docs.sparkSession
    arrow_limits(spark)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    has, lang = free_name(docs.columns, "_has"), free_name(docs.columns, "_lang")
    if model is None:
        return F.col(lang), docs.withColumn(lang, nothing)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def best(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        names = np.array(net.langs, object)
        for texts in parts:
            p = [classify(net, x["text"]) for x in tb.blocks(pa.record_batch([texts], ["text"]), most=1 << 20)]
            p = np.concatenate(p) if p else np.zeros((0, len(names)))
            yield pa.StructArray.from_arrays([pa.array(names[p.argmax(1)], pa.string()), pa.array(np.minimum(p.max(1), 1.0), pa.float64())], names=["lang_pred", "score"])

    rows = docs.withColumn(has, letters).withColumn(lang, best(F.when(F.col(has), F.col(text))))
    return F.col(lang), rows.withColumn(lang, F.when(F.col(has), F.col(lang)).otherwise(nothing)).drop(has)


def identify(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod ``folds`` is not ``held``; predict all rows of ``docs``."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    out = F.coalesce(remainder == held, F.lit(False))
    model = fit(docs.where(~out), sample)
    found, rows = predict(docs.select("doc_id", "text", out.alias("held_out")), model)
    return rows.select("doc_id", "held_out", found["lang_pred"].alias("lang_pred"), found["score"].alias("score"))


def filter_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` in a recognised language: neither ``und`` nor spread over all languages.

    Without any labelled row there is nothing to recognise: then only null texts and texts without a letter go.
    """
    model = fit(docs)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found, rows = predict(docs, model)
    return rows.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= least)).select(*docs.columns)
