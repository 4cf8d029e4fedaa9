"""SentencePiece encoding and decoding by vectorised merge rounds.

Ids equal those of the sentencepiece library for a byte-pair model with identity normalisation and
byte fallback. No piece of such a model holds a space mark after another character, so no merge
crosses from a word into the spaces before the next one: a text falls apart into units (spaces with
the word after them, and line ends where no piece holds one), each merged once for all its
occurrences. The model's bytes travel as a broadcast (its size is fixed); each document is encoded
whole, in one pass without a shuffle.

Defined results: a null text counts as empty and gives only the begin and end ids, decoding to the
empty text. Null ids, repeated rows and other columns are of no account.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from millrace.llm.common import pieces as cut
from millrace.llm.common import document_columns, ship
from millrace.llm.merges import PairTable, UnitStore, merge_words

MARK = "▁"
_loaded: dict[bytes, PieceModel] = {}


class PieceModel:
    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(data)
        norm, spec = model.normalizer_spec, model.trainer_spec
        kinds = [p.type for p in model.pieces]
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix or {4, 5} & {*kinds}:
            raise ValueError("needs a byte-pair model with identity normalisation and no user-defined or unused pieces")
        self.prefix, self.bos, self.eos = norm.add_dummy_prefix, spec.bos_id, spec.eos_id
        names = [p.piece for p in model.pieces]
        self.normal = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == 1}
        if any(MARK in n.lstrip(MARK) for n in self.normal):
            raise ValueError("a piece holds a space mark after another character")
        self.byte_ids = np.zeros(256, np.int32)
        for i, (n, k) in enumerate(zip(names, kinds, strict=True)):
            if k == 6:
                self.byte_ids[int(n[3:-1], 16)] = i
        self.n = len(names)
        symbol = dict(self.normal)  # characters that only occur inside pieces get ids past the last
        for n in self.normal:
            for ch in n:
                symbol.setdefault(ch, self.n + ord(ch))
        self.of_char = np.arange(0x110000, dtype=np.int32) + self.n
        for ch, i in symbol.items():
            if len(ch) == 1:
                self.of_char[ord(ch)] = i
        scores = np.array([p.score for p in model.pieces])
        order = {s: r for r, s in enumerate(sorted({*scores.tolist()}, reverse=True))}
        left, right, rank, new = [], [], [], []
        for n, i in self.normal.items():
            for k in range(1, len(n)):
                a, b = symbol.get(n[:k]), symbol.get(n[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(order[float(scores[i])]), new.append(i)  # noqa: B018
        self.table = PairTable(*(np.array(x, np.int64) for x in (left, right, rank, new)))
        apart = "\n" if not any("\n" in n and len(n) > 1 for n in self.normal) else ""
        self.lines = bool(apart)
        self.split = re.compile(f" +[^ {apart}]*|[^ {apart}]+|{apart}" if apart else " +[^ ]*|[^ ]+").findall
        # for decoding: each id's bytes in one array
        texts = [n.replace(MARK, " ").encode() if k == 1 else bytes([int(n[3:-1], 16)]) if k == 6 else spec.unk_surface.encode() if k == 2 else b"" for n, k in zip(names, kinds, strict=True)]
        self.piece_len = np.array([len(t) for t in texts], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.leads = np.array([k == 1 and n.startswith(MARK) for n, k in zip(names, kinds, strict=True)])
        self.is_byte, self.control = np.array(kinds) == 6, np.array(kinds) == 3
        self.store = UnitStore(self.encode_units)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A unit starts with a line end, or with "\\0" if it must be taken as it is, or else after one space."""
        units = [u[1:] if u[:1] == "\0" else u if u[:1] == "\n" and self.lines else " " + u for u in units]
        lengths = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("".join(units).replace(" ", MARK).encode("utf-32-le"), "<u4")
        flat, sizes = merge_words(self.of_char[codes], lengths, self.table)
        odd = np.flatnonzero(flat >= self.n)
        if len(odd):  # byte fallback
            owner = np.repeat(np.arange(len(units)), sizes)
            raw = [chr(c - self.n).encode() for c in flat[odd].tolist()]
            wide = np.ones(len(flat), np.int64)
            wide[odd] = [len(r) for r in raw]
            sizes = np.bincount(owner, wide, len(units)).astype(np.int64)
            spread = np.repeat(flat, wide)
            spread[np.repeat(np.isin(np.arange(len(flat)), odd), wide)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            flat = spread
        return flat, sizes

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if not self.prefix or not self.lines or "  " in text or text[0] in " \n" or "\0" in text:  # runs of spaces and the like
            return ["\0" + u for u in self.split(" " + text if self.prefix else text)]
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with begin and end ids, and each text's number of ids."""
        flat, sizes = self.store.ids([self.units(t) for t in texts])
        total = sizes + 2
        ends = np.cumsum(total)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        inner = np.ones(len(out), bool)
        inner[ends - total], inner[ends - 1] = False, False
        out[inner] = flat
        out[ends - total], out[ends - 1] = self.bos, self.eos
        return out, total

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[str]:
        if not len(flat):
            return [""] * len(sizes)
        wide = self.piece_len[flat]
        ends = np.cumsum(wide)
        data = self.piece_bytes[np.repeat(self.piece_at[flat] - (ends - wide), wide) + np.arange(ends[-1])].tobytes()
        last = np.cumsum(sizes)
        upto = np.append(0, ends)
        out = []
        for a, b in zip((last - sizes).tolist(), last.tolist(), strict=True):
            first = a
            while first < b and self.control[flat[first]]:
                first += 1
            strip = int(first < b and self.prefix and self.leads[flat[first]])
            held = data[upto[a] + strip : upto[b]]
            end = b
            while end > first and self.control[flat[end - 1]]:
                end -= 1
            if self.control[flat[first:end]].any():  # a control id parts two runs of byte pieces
                out.append(self._mend(flat[a:b], strip))
                continue
            try:
                out.append(held.decode())
            except UnicodeDecodeError:
                out.append(self._mend(flat[a:b], strip))
        return out

    def _mend(self, ids: np.ndarray, strip: int) -> str:
        """Runs of byte pieces that aren't UTF-8: one U+FFFD for each byte that starts no character."""
        out, run = [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + k]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k = 1
                i += k
            run.clear()

        for i in ids.tolist():
            held = self.piece_bytes[self.piece_at[i] : self.piece_at[i] + self.piece_len[i]].tobytes()
            if self.is_byte[i]:
                run += held
            else:
                flush()
                out.append(held.decode())
        flush()
        return "".join(out)[strip:]


def load(data: bytes) -> PieceModel:
    """One model a worker process; what it has met stays for the worker's next task."""
    key = hashlib.sha256(data).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceModel(data)
    return _loaded[key]


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """The columns of `docs`, with ids (optional), n_tokens, ids_sha256 and decoded_sha256."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(held.value)
        for b in cut(batches, limit=4 << 20):
            flat, sizes = m.encode(b.column("text").to_pylist())
            last = np.cumsum(sizes)
            raw = flat.astype("<u4").tobytes()
            shas = [hashlib.sha256(raw[4 * (e - s) : 4 * e]).hexdigest() for e, s in zip(last.tolist(), sizes.tolist(), strict=True)]
            texts = [hashlib.sha256(t.encode()).hexdigest() for t in m.decode(flat, sizes)]
            ids = [pa.ListArray.from_arrays(pa.array(np.append(0, last), pa.int32()), pa.array(flat, pa.int32()))] if with_ids else []
            names = ["ids"] if with_ids else []
            yield pa.RecordBatch.from_arrays([*b.columns, *ids, pa.array(sizes), pa.array(shas), pa.array(texts)], [*b.schema.names, *names, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = StructType([*docs.schema.fields])
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    return docs.mapInArrow(run, schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))


def op6(docs: DataFrame, model: str | None = None) -> DataFrame:
    return encode(document_columns(docs, "doc_id", "text"), model, with_ids=False).drop("text")
