"""Language-model scoring by a hidden Markov model over words.

Tokens are lower-cased words and one end a document. Words of the training rows are counted exactly.
The HOT most frequent of at most HOT_BYTES bytes have an emission of their own; all others share one by the hash of their last
three bytes, and within it a word has its share of counts plus one, an unseen one a single share. So
emissions are a bounded table whatever the vocabulary, and every text has an exact probability:

    P(text) = P_hmm(emission classes of its tokens) x product over rare tokens of (c + 1) / (C_class + 1)

where C_class sums c + 1 over the class's words. Baum-Welch starts on a bounded sample of whole training
documents (`sample_docs` of those of at most `sample_chars` characters; the shortest one if there is none); then every round's expected counts cover all training rows: each task sums them over its
whole documents (whose stretches of SEGMENT tokens walk side by side and are joined exactly), they are added across tasks, and the driver normalises one bounded table.
Scoring runs the scaled forward recursion over whole documents, many side by side.

Counts of rare words reach documents by a join on the word; nothing that grows with the vocabulary is
broadcast or collected.

Defined results: a null text counts as empty and has the end alone. A null doc_id trains as the empty
id would. Without training rows all counts are 0. Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import document_columns, pieces, remainder, sampled, ship, write_table

STATES, HOT, CLASSES, ROUNDS, SEGMENT = 8, 1 << 15, 1 << 15, 2, 256
#: Bytes of a word that may have an emission of its own, so that all of them together are bounded.
HOT_BYTES = 64
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ROUNDS = 600, 20_000, 12
#: Words that a task counts before it passes them on; bounds its memory.
HELD = 300_000
#: A line end can't be part of a word, so it stands for the end.
END = b"\n"
PRIOR = 5000.0


def words(text: str | None) -> list[bytes]:
    """Words between white space (bytes 0x20 and 0x09 to 0x0D), A-Z in lower case, and the end."""
    out = text.encode().lower().split() if text else []
    out.append(END)
    return out


class Classes(dict):
    """Word -> emission class: its own number if hot, else one past HOT by its last bytes."""

    def __init__(self, hot: dict[bytes, int]):
        super().__init__(hot)
        self.hot = hot

    def __missing__(self, word: bytes) -> int:
        if len(self) > HOT + HELD:
            self.clear()
            self.update(self.hot)
        self[word] = k = HOT + zlib.crc32(word[-3:]) % CLASSES
        return k


class Model:
    """Start and transition probabilities, and each class's probability by state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
        emit = emit + PRIOR * share[:, None]
        return cls((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), emit / emit.sum(0))


def lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of sequences from long to short, and how many are longer than each step."""
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")


def forward(model: Model, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence of classes."""
    out = np.zeros(len(sizes))
    order, active = lanes(sizes)
    at = (np.cumsum(sizes) - sizes)[order]
    alpha = np.broadcast_to(model.start, (len(sizes), len(model.start)))
    total = np.zeros(len(sizes))
    for t, k in enumerate(active.tolist()):
        alpha = (alpha[:k] @ model.move if t else alpha[:k]) * model.emit[flat[at[:k] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:k] += np.log10(scale)
    out[order] = total
    return out


def _bounds(model: Model, flat: np.ndarray, cut: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What whole sequences bring to their stretches: the states' probabilities before the first token, and, up to scale, the backward values at the last."""
    n = len(model.start)
    before, after = np.tile(model.start, (len(cut), 1)), np.ones((len(cut), n))
    rows = np.flatnonzero(np.repeat(parts > 1, parts))
    if not len(rows):
        return before, after
    # how each stretch carries any state before it to those at its end
    order, active = lanes(cut[rows])
    at = (np.cumsum(cut) - cut)[rows][order]
    carry = np.tile(np.eye(n), (len(rows), 1, 1))
    for t, k in enumerate(active.tolist()):
        moved = (carry[:k].reshape(-1, n) @ model.move).reshape(k, n, n) if t else carry[:k]
        carry[:k] = moved * model.emit[flat[at[:k] + t]][:, None, :]
        if t % 8 == 7:
            carry[:k] /= carry[:k].sum((1, 2), keepdims=True)
    through = np.empty((len(cut), n, n))
    through[rows[order]] = carry
    by_parts, longer = lanes(parts)
    first = (np.cumsum(parts) - parts)[by_parts]
    for j in range(1, len(longer)):
        i = first[: longer[j]] + j
        x = (before[i - 1][:, None] @ through[i - 1])[:, 0] @ model.move
        before[i] = x / x.sum(1, keepdims=True)
    for j in range(len(longer) - 1, 0, -1):
        i = first[: longer[j]] + j
        x = (through[i] @ after[i][:, :, None])[:, :, 0] @ model.move.T
        after[i - 1] = x / x.sum(1, keepdims=True)
    return before, after


def expected(model: Model, flat: np.ndarray, sizes: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Add whole sequences' expected counts of starts, moves and emissions (forward and backward, scaled)."""
    starts, moves, emits = into
    cut, parts = _stretches(flat, sizes), -(-sizes // SEGMENT)
    before, after = _bounds(model, flat, cut, parts)
    order, active = lanes(cut)
    at = (np.cumsum(cut) - cut)[order]
    n = len(model.start)
    alphas, scales, tokens = [], [], []
    alpha, after = before[order], after[order]
    for t, k in enumerate(active.tolist()):
        token = flat[at[:k] + t]
        alpha = (alpha[:k] @ model.move if t else alpha[:k]) * model.emit[token]
        scale = alpha.sum(1, keepdims=True)
        alpha = alpha / scale
        alphas.append(alpha), scales.append(scale), tokens.append(token)  # noqa: B018
    beta = np.ones((0, n))
    gammas = [None] * len(alphas)
    final = np.zeros((len(cut), n))
    for t in range(len(alphas) - 1, -1, -1):
        k, m = len(alphas[t]), len(beta)
        now = after[:k].copy()
        if k > m:
            final[order[m:k]] = alphas[t][m:]
            now[m:] /= (alphas[t][m:] * now[m:]).sum(1, keepdims=True)
        if m:
            ahead = model.emit[tokens[t + 1]] * beta / scales[t + 1]
            now[:m] = ahead @ model.move.T
            moves += model.move * (alphas[t][:m].T @ ahead)
        beta = now
        gammas[t] = alphas[t] * beta
    if gammas:
        head = np.zeros(len(cut), bool)
        head[(np.cumsum(parts) - parts)[parts > 0]] = True
        starts += gammas[0][head[order]].sum(0)
        # the moves across cuts
        ahead = np.empty((len(cut), n))
        ahead[order] = model.emit[tokens[0]] * beta / scales[0]
        later = np.flatnonzero(~head)
        moves += model.move * (final[later - 1].T @ ahead[later])
        every, gamma = np.concatenate(tokens), np.concatenate(gammas)
        for s in range(n):
            emits[:, s] += np.bincount(every, gamma[:, s], len(emits))


def _stretches(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes after cutting sequences to SEGMENT tokens at most, in the same order."""
    parts = -(-sizes // SEGMENT)
    out = np.full(int(parts.sum()), SEGMENT, np.int64)
    last = np.cumsum(parts) - 1
    out[last] = sizes - (parts - 1) * SEGMENT
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
        held.clear()
        return out

    for b in batches:
        for text in b.column("text").to_pylist():
            held.update(words(text))
            if len(held) > HELD:
                yield rows()
    yield rows()


def _classed(batches: Iterator[pa.RecordBatch], table: Classes, tokens: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Flat classes and sizes of about so many tokens of text."""
    flat: list[int] = []
    sizes: list[int] = []
    for b in pieces(batches, limit=1 << 20):
        for text in b.column("text").to_pylist():
            w = words(text)
            sizes.append(len(w))
            flat.extend(map(table.__getitem__, w))
            if len(flat) > tokens:
                yield np.array(flat, np.int64), np.array(sizes, np.int64)
                flat, sizes = [], []
    if flat:
        yield np.array(flat, np.int64), np.array(sizes, np.int64)


def first_model(texts: list[str], hot: dict[bytes, int], share: np.ndarray, states: int) -> Model:
    """Baum-Welch on a bounded sample, from documents dealt to states at random, with states that last."""
    rng, table = np.random.default_rng(11), Classes(hot)
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    docs = [[table[w] for w in words(t)] for t in texts]
    flat, sizes = np.array([c for d in docs for c in d], np.int64), np.array([len(d) for d in docs], np.int64)
    weight = rng.dirichlet(np.full(states, 0.3), len(docs)).repeat(sizes, axis=0) if docs else np.zeros((0, states))
    emit = np.stack([np.bincount(flat, weight[:, s], len(share)) for s in range(states)], 1)
    model = Model.of_counts(np.ones(states), 1000 * move, emit, share)
    for _ in range(SAMPLE_ROUNDS if docs else 0):
        into = (np.zeros(states), np.zeros((states, states)), np.zeros((len(share), states)))
        expected(model, flat, sizes, into)
        model = Model.of_counts(*into, share)
    return model


class Trained:
    """What scoring needs: bounded tables, and the word counts as a DataFrame."""

    def __init__(self, model: Model, hot: dict[bytes, int], hot_counts: np.ndarray, class_mass: np.ndarray, counts: DataFrame, total: int, distinct: int):
        self.model, self.hot, self.hot_counts, self.class_mass = model, hot, hot_counts, class_mass
        self.counts, self.total, self.distinct = counts, total, distinct


def train(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Trained:
    """Learn from all of `docs` (doc_id, text); the two last parameters bound the sample that the first model is made from."""
    spark = docs.sparkSession
    ship(spark)
    counts = write_table(docs.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the HOT words: from whole bins of the logarithm of the count, the greatest first, as many as fit
    step = F.floor(F.log2("c") * 32)
    cut, held = None, 0
    short = F.length("word") <= HOT_BYTES
    for b, n in sorted(counts.where(short).groupBy(step.alias("b")).count().collect(), reverse=True):  # at most 32 x 64 rows
        held += n
        if held > HOT:
            break
        cut = b
    top = sorted(counts.where(short & (step >= cut)).collect(), key=lambda r: (-r.c, r.word)) if cut is not None else []  # at most HOT rows
    hot = {bytes(r.word): i for i, r in enumerate(top)}
    mass = np.zeros(HOT + CLASSES)
    mass[: len(top)] = [r.c + 1 for r in top]
    rare = counts.where(~short | (step < cut)) if cut is not None else counts
    key = F.crc32(F.expr("substring(word, -3, 3)")) % CLASSES
    for k, m in rare.groupBy(key.alias("k")).agg(F.sum(F.col("c") + 1)).collect():  # at most CLASSES rows
        mass[HOT + k] = m
    share = (mass + 1) / (mass + 1).sum()
    sample = sampled(docs.where(F.length("text") <= sample_chars), "doc_id", sample_docs).collect()
    sample = sample or docs.where("text is not null").orderBy(F.length("text"), "text").limit(1).collect()
    model = first_model([r.text for r in sample], hot, share, states)
    sums = [F.sum(F.col("v")[s]).alias(f"v{s}") for s in range(states)]
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((model, hot))  # (HOT + CLASSES) x states numbers, HOT words

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            model, hot = held.value
            n = len(model.start)
            into = (np.zeros(n), np.zeros((n, n)), np.zeros((len(model.emit), n)))
            for flat, sizes in _classed(batches, Classes(hot)):
                expected(model, flat, sizes, into)
            used = np.flatnonzero(into[2].any(1))
            rows = np.concatenate([into[0][None], into[1], into[2][used]])
            keys = np.concatenate([-np.arange(1, n + 2), used])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(rows), pa.list_(pa.float64()))], ["k", "v"])

        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((HOT + CLASSES, states))
        for k, *v in docs.select("text").mapInArrow(run, "k long, v array<double>").groupBy("k").agg(*sums).collect():
            if k >= 0:
                emit[k] = v
            elif k == -1:
                start[:] = v
            else:
                move[-k - 2] = v
        model = Model.of_counts(start, move, emit, share)
        held.unpersist()
    return Trained(model, hot, np.array([r.c for r in top] or [0], np.float64), mass[HOT:], counts, int(total), int(distinct))


def score(docs: DataFrame, trained: Trained) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast((trained.model, trained.hot, trained.hot_counts, trained.class_mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hot, hot_counts, mass = held.value
        table = Classes(hot)
        logs, masses = np.log10(hot_counts + 1), np.log10(mass + 1)
        for b in pieces(batches, limit=8 << 20):
            flat: list[int] = []
            sizes, rare_words, rare_times = [], [], []
            for text in b.column("text").to_pylist():
                w = words(text)
                c = list(map(table.__getitem__, w))
                rare = Counter([x for x, k in zip(w, c, strict=True) if k >= HOT])
                flat += c
                sizes.append(len(w))
                rare_words.append(list(rare))
                rare_times.append(list(rare.values()))
            classes, n = np.array(flat, np.int64), np.array(sizes, np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            common = classes < HOT
            plain = np.bincount(owner[common], logs[classes[common]], len(n))
            apart = np.bincount(owner[~common], masses[classes[~common] - HOT], len(n))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(np.bincount(owner[common], minlength=len(n))), pa.array(forward(model, classes, n) - apart), pa.array(plain), pa.array(rare_words, pa.list_(pa.binary())), pa.array(rare_times, pa.list_(pa.int64()))],
                ["doc_id", "n_tokens", "n_hot", "hmm", "plain", "words", "times"],
            )

    # the row number is fixed by the table that is written
    rows = docs.mapInArrow(run, "doc_id long, n_tokens long, n_hot long, hmm double, plain double, words array<binary>, times array<long>").withColumn("row", F.monotonically_increasing_id())
    rows = write_table(rows, "scored")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    sums = rare.join(trained.counts, "word").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("shares"))
    every = rows.drop("words", "times").join(sums, "row", "left")
    shares = F.coalesce("shares", F.lit(0.0))
    base = F.col("plain") + shares - F.col("n_tokens") * F.lit(float(np.log10(trained.total + trained.distinct + 1)))
    return every.select(
        "doc_id", "n_tokens", (F.col("n_hot") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(trained.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("hmm") + shares).alias("score"),
    )


def op1(docs: DataFrame) -> DataFrame:
    docs = document_columns(docs, "doc_id", "text")
    held = remainder(F.col("doc_id"), 7) == 2
    return score(docs, train(docs.where(~held))).withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
