"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text are hashed n-grams of its white-space words: the lower-cased word core (1- and
2-grams) and the word's outline, which is its case pattern with the marks around it, or "=" for a
word that repeats the one before (1-, 2- and 3-grams). A feature's value is its share of the text's
words, so a score is one sparse dot product whatever the text's length; whole texts are read.

Labels are learned from a bounded sample (``max_train`` labelled documents, those of least hashed
id), in one task on an executor. Scoring is one pass without a shuffle.

Defined results: a null or empty text has no features and scores the bias alone; with no labels, or
labels of one class, every score is the labels' mean (0.5 without labels). Null labels are ignored, several labels of
one document are averaged (a tie counts as 1). A null doc_id is scored like any row. Columns other
than those named are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from millrace.llm.common import document_columns, pieces, remainder, sampled, ship

BITS = 18
MAX_TRAIN = 4000
_RUN = re.compile(r"(.)\1{2,}", re.S)


def _outline(word: str) -> str:
    """The case pattern of a word: runs of letters shrink to a sign, other marks stay."""
    out = []
    for ch in word:
        sign = "9" if ch.isdigit() else ("A" if ch.isupper() else "a") if ch.isalpha() else ch
        if not out or out[-1] != sign or sign not in "Aa9":
            out.append(sign)
    return "".join(out)


class Features:
    """Words to hashed n-grams, batch by batch."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature ids, the text each belongs to, and each text's number of words."""
        seen: dict[str, int] = {}
        ids, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = (text or "").split()
            counts[i] = len(words)
            ids.extend([seen.setdefault(w, len(seen)) for w in words])
        at = np.array(ids, np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
        core, line = np.empty(len(seen), np.uint64), np.empty(len(seen), np.uint64)
        for w, k in seen.items():
            core[k] = zlib.crc32(w.lower().strip(".,;:!?#$%&*|()[]{}\"'<>/\\-_=+~^").encode())
            line[k] = zlib.crc32(_RUN.sub(r"\1\1\1", _outline(w)).encode())
        again = np.zeros(len(at), bool)
        again[1:] = (at[1:] == at[:-1]) & (owner[1:] == owner[:-1])
        c, o = core[at], np.where(again, np.uint64(61), line[at])
        feats, owners = [self.hashed(c, 1), self.hashed(o, 2)], [owner, owner]
        two = owner[1:] == owner[:-1]
        feats += [self.hashed(self.join(c[:-1], c[1:]), 3)[two], self.hashed(self.join(o[:-1], o[1:]), 4)[two]]
        owners += [owner[1:][two]] * 2
        if len(at) > 2:
            three = owner[2:] == owner[:-2]
            feats.append(self.hashed(self.join(self.join(o[:-2], o[1:-1]), o[2:]), 5)[three])
            owners.append(owner[2:][three])
        return np.concatenate(feats), np.concatenate(owners), counts

    @staticmethod
    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))

    def hashed(self, x: np.ndarray, family: int) -> np.ndarray:
        x = (x + np.uint64(family)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) & self.mask).astype(np.int64)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


#: Shares of a text's words are small; this puts them on the scale of the bias.
SCALE = 20.0


def vectors(made: Features, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct feature ids and their values."""
    feats, owner, counts = made.batch(texts)
    order = np.argsort(owner, kind="stable")
    feats, cuts = feats[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
    out = []
    for k in range(len(texts)):
        ids, n = np.unique(feats[cuts[k] : cuts[k + 1]], return_counts=True)
        out.append((ids, SCALE * n / max(counts[k], 1)))
    return out


def fit(docs: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS, epochs: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias from (feature ids, values, label) rows in an order that is repeatable."""
    labels = [y for _, _, y in docs]
    if not labels or min(labels) == max(labels):
        mean = sum(labels) / len(labels) if labels else 0.5
        return np.zeros(1 << bits), float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
    size = 1 << bits
    model, order = Ftrl(size + 1), np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(docs)):
            at, x, y = docs[k]
            model.learn(np.append(at, size), np.append(x, 1.0), y)
    w = model.weights()
    return w[:size], float(w[size])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Fit on at most `max_train` labelled documents whose id leaves a remainder other than 1 by 3.

    Texts become sparse vectors where they lie, so what meets in the one task that fits is bounded by
    `max_train` rows of 2**bits entries at most, however long the texts.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = (
        document_columns(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").where(remainder(F.col("doc_id"), 3) != 1)
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    )
    chosen = sampled(chosen, "doc_id", max_train)
    # at most max_train rows of 16 bytes: a proven bound
    found = document_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("place"), "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text", "label")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(bits)
        for b in pieces(batches, limit=1 << 20):
            held = vectors(made, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("place", "doc_id", "digest", "label")), pa.array([i.astype(np.int32) for i, _ in held], pa.list_(pa.int32())), pa.array([x for _, x in held], pa.list_(pa.float64()))],
                ["place", "doc_id", "digest", "label", "ids", "x"],
            )

    shape = StructType([f for f in found.schema.fields if f.name in ("place", "doc_id", "digest")])
    shape = shape.add("label", "double").add("ids", ArrayType(IntegerType())).add("x", ArrayType(DoubleType()))
    sample = found.mapInArrow(sparse, shape).orderBy("place", "doc_id", "digest").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for ids, x, y in zip(b.column("ids"), b.column("x"), b.column("label").to_pylist(), strict=True):
                rows.append((ids.values.to_numpy().astype(np.int64), x.values.to_numpy(), y))
        w, bias = fit(rows, bits)
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.astype("<f4").tobytes()], pa.binary()), "bias": [bias]})

    made = sample.coalesce(1).mapInArrow(run, "w binary, bias double").collect()
    if not made:
        return fit([], bits)
    return np.frombuffer(made[0].w, "<f4"), made[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS) -> DataFrame:
    """The columns of `docs` and a double `score`; one pass, no shuffle. `docs` needs a text column."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast((np.asarray(model[0], np.float32), model[1]))  # 2**bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = held.value
        made = Features(bits)
        for b in pieces(batches, limit=4 << 20):
            feats, owner, counts = made.batch(b.column("text").to_pylist())
            total = np.bincount(owner, w[feats], len(counts)) if len(feats) else np.zeros(len(counts))
            p = 1 / (1 + np.exp(-np.clip(bias + SCALE * total / np.maximum(counts, 1), -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("score", "double"))


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(document_columns(docs, "doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
