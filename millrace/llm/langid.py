"""Language identification by cross-parsing entropy.

Each language's training text becomes a suffix automaton. A text is parsed against it greedily: from
where the last phrase ended, the longest string that occurs in the training text is the next phrase.
Phrases times the logarithm of the training length, per letter or space, estimate the cross entropy;
the language with the least wins, ties going to the lesser name.

Texts are brought to lower-case letters with single spaces for all else, and parsed whole. A batch's texts
are walked side by side in numpy, in stretches of BLOCK signs: each is parsed as if a phrase began with it, then
again from the state in which the stretch before it ended, only as far as the two walks differ, until no
stretch's entry changes. That is the parse of the whole text, phrase by phrase.

Every letter of the training texts has a sign: moves by the most frequent letters lie in a full table of at most
TABLE entries, moves by all others in a sorted list, searched only where a text has such a letter. Training is a
bounded sample of whole documents a language: up to `max_docs`, of least hashed id, that together have at most
`max_signs` signs; texts of 200 to `max_chars` characters come first, then shorter ones. Where a language has
longer texts alone, its shortest is taken, whole. Scoring is one pass without a shuffle.

Defined results: `und` with score 0 for a null text, one without a letter, or no training text at all.
Score is second / (best + second), from 0.5 (a tie) to 1; 1 if only one language was learned. Null languages are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import document_columns, pieces, remainder, ship

#: Bounds of the training sample, by language: documents, signs, and characters of a document.
MAX_DOCS, MAX_SIGNS, MAX_CHARS = 60, 24_000, 20_000
#: Letters and entries of the full table of moves.
LETTERS, TABLE = 120, 1 << 24
BLOCK = 1024
_signs: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """Code point -> code point of its lower-case letter; 0 for what is no letter."""
    if not _signs:
        out = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _signs.append(out)
    return _signs[0]


def plain(text: str) -> np.ndarray:
    """Lower-case letters' code points, with one 0 for each run of other signs."""
    codes = _lower()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def suffix_automaton(signs: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    after, link, length, last = [{}], [-1], [0], 0
    for c in signs:
        cur = len(after)
        after.append({}), link.append(0), length.append(length[last] + 1)  # noqa: B018
        p = last
        while p != -1 and c not in after[p]:
            after[p][c] = cur
            p = link[p]
        if p != -1:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(after)
                after.append(dict(after[q])), link.append(link[q]), length.append(length[p] + 1)  # noqa: B018
                while p != -1 and after[p].get(c) == q:
                    after[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return after


class Parser:
    """All languages' automata in one table and one list. State 0 is "no match"; sign 0 is unknown, 1 the space."""

    def __init__(self, texts: dict[str, list[str]], max_signs: int = MAX_SIGNS, letters: int = LETTERS):
        held, count = {}, {}
        for lang, docs in sorted(texts.items()):
            parts, n = [], 0
            for codes in map(plain, docs):
                if not parts or n + len(codes) <= max_signs:
                    parts.append(codes)
                    n += len(codes)
            held[lang] = parts
            for x in parts:
                for c, k in zip(*np.unique(x, return_counts=True), strict=True):
                    count[int(c)] = count.get(int(c), 0) + int(k)
        self.langs = [x for x in held if sum(map(len, held[x]))]
        known = sorted((c for c in count if c), key=lambda c: (-count[c], c))
        self.sign = {0: 1} | {c: i + 2 for i, c in enumerate(known)}
        autos, self.start, self.weight, at = [], [], [], 1
        for lang in self.langs:
            signs = [s for x in held[lang] for s in [*(self.sign[int(c)] for c in x), 1]]
            autos.append(suffix_automaton(signs))
            self.start.append(at)
            self.weight.append(float(np.log2(len(signs) + 1)))
            at += len(autos[-1])
        self.signs, self.width = len(known) + 2, min(len(known), letters, TABLE // at) + 2
        table = np.zeros((at, self.width), np.int32)
        rare: list[tuple[int, int]] = []
        for first, auto in zip(self.start, autos, strict=True):
            for s, go in enumerate(auto, first):
                for c, z in go.items():
                    if c < self.width:
                        table[s, c] = first + z
                    else:
                        rare.append((s * self.signs + c, first + z))
        self.table = table.ravel()
        rare.sort()
        self.keys, self.goes = np.array([k for k, _ in rare], np.int64), np.array([z for _, z in rare], np.int32)

    def open(self) -> None:
        """After the journey to a worker: the code-point table and each language's first steps."""
        self.of = np.zeros(0x110000, np.int32)
        for c, s in self.sign.items():
            self.of[c] = s
        start = np.array(self.start, np.int32)
        first = self._moves(np.repeat(start[:, None], self.signs, 1), np.arange(self.signs, dtype=np.int32))
        self.first = np.where(first == 0, start[:, None], first).astype(np.int32)  # an unknown sign is a phrase of its own

    def _moves(self, states: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """States (language, place) after each place's sign; 0 where there is no move."""
        rare = np.flatnonzero(signs >= self.width) if len(self.keys) else []
        if not len(rare):
            return self.table[states * self.width + signs]
        to = self.table[states * self.width + np.where(signs < self.width, signs, 0)]
        key = states[:, rare].astype(np.int64) * self.signs + signs[rare]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        to[:, rare] = np.where(self.keys[at] == key, self.goes[at], 0)
        return to

    def _parse(self, signs: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end within each stretch, and the state at its end, by language; a phrase begins with each."""
        m = len(starts)
        order = np.argsort(-lens, kind="stable")
        at, size = starts[order], lens[order]
        root = np.repeat(np.array(self.start, np.int32)[:, None], m, 1)
        state, ended = root.copy(), np.zeros((len(self.langs), m), np.int64)
        active = np.searchsorted(-size, -np.arange(size[0]), "left")  # stretches longer than each step
        for t, k in enumerate(active.tolist()):
            c = signs[at[:k] + t]
            s = state[:, :k]
            to = self._moves(s, c)
            miss = to == 0
            begin = self.first[:, c]
            # the phrase before ends; a sign that the language lacks is a phrase by itself at once
            ended[:, :k] += miss & (s != root[:, :k])
            ended[:, :k] += miss & (begin == root[:, :k])
            state[:, :k] = np.where(miss, begin, to)
        back = np.empty(m, np.int64)
        back[order] = np.arange(m)
        return ended[:, back], state[:, back]

    def _step(self, lang: np.ndarray, state: np.ndarray, sign: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self._moves(state[None], sign)[0]
        miss, begin = to == 0, self.first[lang, sign]
        return np.where(miss, begin, to), (miss & (state != root)).astype(np.int64) + (miss & (begin == root))

    def _mend(self, signs: np.ndarray, starts: np.ndarray, lens: np.ndarray, heads: np.ndarray, ended: np.ndarray, final: np.ndarray) -> None:
        """Bring counts and end states to those of a walk that goes on from each stretch into the next."""
        roots = np.array(self.start, np.int32)
        entry = np.repeat(roots[:, None], len(starts), 1)
        lang, block = np.nonzero(np.broadcast_to(~heads, ended.shape))
        while len(lang):
            new = final[lang, block - 1]
            go = new != entry[lang, block]
            lang, block, new = lang[go], block[go], new[go]
            old = entry[lang, block]
            entry[lang, block] = new
            x, b, at, left = lang, block, starts[block], lens[block]
            moved: list[tuple[np.ndarray, np.ndarray]] = []
            while len(x):
                c, root = signs[at], roots[x]
                old, gone = self._step(x, old, c, root)
                new, come = self._step(x, new, c, root)
                ended[x, b] += come - gone
                at, left = at + 1, left - 1
                over = (left == 0) & (old != new)
                if over.any():
                    final[x[over], b[over]] = new[over]
                    moved.append((x[over], b[over] + 1))
                on = (left > 0) & (old != new)
                x, b, at, left, old, new = x[on], b[on], at[on], left[on], old[on], new[on]
            lang, block = (np.concatenate([m[i] for m in moved]) if moved else np.zeros(0, np.int64) for i in (0, 1))
            inside = block < len(starts)
            lang, block = lang[inside], block[inside]
            lang, block = lang[~heads[block]], block[~heads[block]]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a sign, by text and language, and which texts have a letter."""
        codes = [plain(t) if t else np.zeros(0, np.int32) for t in texts]
        letters = np.array([bool((c != 0).any()) for c in codes])
        sizes = np.array([len(c) for c in codes], np.int64)
        signs = self.of[np.concatenate(codes)] if len(codes) else np.zeros(0, np.int32)
        phrases = np.zeros((len(codes), len(self.langs)))
        if len(signs) and self.langs:
            parts = -(-sizes // BLOCK)
            owner = np.repeat(np.arange(len(codes)), parts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            starts = (np.cumsum(sizes) - sizes)[owner] + place * BLOCK
            lens = np.minimum(BLOCK, sizes[owner] - place * BLOCK)
            ended, final = self._parse(signs, starts, lens)
            self._mend(signs, starts, lens, place == 0, ended, final)
            last = place == parts[owner] - 1
            ended += last & (final != np.array(self.start, np.int32)[:, None])
            for x in range(len(self.langs)):
                phrases[:, x] = np.bincount(owner, ended[x], len(codes))
        return phrases * np.array(self.weight) / np.maximum(sizes, 1)[:, None], letters


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_signs: int = MAX_SIGNS, max_chars: int = MAX_CHARS) -> Parser:
    """Learn from (doc_id, text, lang) rows: at most `max_docs` documents a language reach the driver, each whole."""
    rows = document_columns(docs, "doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null")
    n = F.length("text")
    odd = F.when(n > max_chars, 2).when(n < 200, 1).otherwise(0)
    # the filter on the row number keeps each task to max_docs rows a language before the exchange
    rank = Window.partitionBy("lang").orderBy("odd", F.when(F.col("odd") == 2, F.col("n")), F.xxhash64("doc_id"), "doc_id")
    sized = rows.select("doc_id", "lang", n.alias("n"), odd.alias("odd"))
    chosen = sized.withColumn("rank", F.row_number().over(rank)).where((F.col("rank") <= max_docs) & ((F.col("odd") < 2) | (F.col("rank") == 1))).select("doc_id", "lang", "rank", "n")
    # max_docs rows a language; a repeated doc_id may bring a text twice
    found = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).where(F.length("text") == F.col("n")).select("lang", "rank", "text")
    texts: dict[str, list[str]] = {}
    for r in sorted({(r.lang, r["rank"], r.text) for r in found.collect()}):
        texts.setdefault(r[0], []).append(r[2])
    return Parser(texts, max_signs)


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """The columns of `docs` with lang_pred and score. `docs` needs a text column."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(parser)  # a table of TABLE entries at most, and a list that the sample bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        p.open()
        names = np.array([*p.langs, "und"], object)
        for b in pieces(batches, limit=4 << 20):
            bits, letters = p.entropies(b.column("text").to_pylist())
            best, score = np.full(len(letters), len(p.langs)), np.zeros(len(letters))
            if p.langs:
                low = bits.argmin(1)
                best = np.where(letters, low, best)
                if len(p.langs) == 1:
                    score = np.where(letters, 1.0, 0.0)
                else:
                    two = np.partition(bits, 1, axis=1)
                    score = np.where(letters, two[:, 1] / np.maximum(two[:, 0] + two[:, 1], 1e-12), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double"))


def op8(docs: DataFrame) -> DataFrame:
    held = remainder(F.col("doc_id"), 5) == 0
    parser = train(docs.where(~held))
    return identify(document_columns(docs, "doc_id", "text"), parser).select("doc_id", held.alias("held_out"), "lang_pred", "score")
