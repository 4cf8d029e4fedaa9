"""Word-level byte-pair encoding with word ends, equal to the tokenizers library's ids.

The tokenizer file is read for its vocabulary, merges and added tokens. White space is dropped by its
pre-tokeniser, so a text falls apart at white space and each unit is encoded once for all its
occurrences. Units of plain Latin letters, ASCII digits and marks fall apart further, into the lower-cased
runs that the pre-tokeniser makes of them, and go through the vectorised merge rounds; all others (and all
units, if the file is of another kind or a check against the library fails) stay whole and are encoded by
the library itself, or by the rounds after splitting by pattern.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np

from millrace.llm.merges import PairTable, SpanStore, merge_words

_LETTERS = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĸĺļľŀłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
_LATIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ž]").fullmatch
#: Of a byte: 0 letter (all that is no ASCII, as only Latin letters get there), 1 digit, 2 mark, 3 space
_CLASS = np.array([3 if b == 32 else 1 if 48 <= b <= 57 else 0 if b >= 128 or 97 <= b <= 122 else 2 for b in range(256)], np.uint8)
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+").findall
#: The normaliser and splitter this fast way stands for.
_NORMAL = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Bytes that part units: all ASCII white space of the normaliser.
_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])
#: ``_CLASS`` of a byte before lower-casing, with all white space
_KIND = np.array([3 if _SPACE[b] else 0 if 65 <= b <= 90 else _CLASS[b] for b in range(256)], np.uint8)
_loaded: dict[bytes, WordModel] = {}


def _byte_signs() -> dict[int, str]:
    """The printable sign of each byte: itself where printable in Latin-1, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)}


def _units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the units between white space begin and end."""
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.append(0, edge)
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    return edge[::2], edge[1::2]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)


class WordModel:
    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        file = json.loads(data)
        self.size = self.library.get_vocab_size()
        self.specials = [t["content"] for t in file["added_tokens"]]
        normal = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (file["normalizer"] or {}).get("normalizers", [])]
        split = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        model = file["model"]
        self.fast = normal == _NORMAL and split[0].get("pattern", {}).get("Regex") == _PATTERN and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"] and not model["ignore_merges"] and not any(re.search(r"\s", t) for t in self.specials)
        self.table = None
        if self.fast:
            vocab = model["vocab"]
            signs = _byte_signs()
            self.inner = np.array([vocab.get(signs[b], -1) for b in range(256)], np.int32)
            self.final = np.array([vocab.get(signs[b] + "</w>", -1) for b in range(256)], np.int32)
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            left, right, new = (np.array([vocab[f(a, b)] for a, b in pairs], np.int64) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a + b))
            self.table = PairTable(left, right, np.arange(len(pairs)), new)
            self.fast = bool((self.inner >= 0).all() and (self.final >= 0).all())
        self.checked = self.held = False
        heads = {t[0] for t in self.specials}
        self.way = np.array([3 if not (c == 32 or _LATIN(chr(c))) else 2 if chr(c) in heads else 1 if c == 39 else 0 for c in range(0x180)] + [3], np.uint8)
        # of a byte: 1 its unit stays whole, 2 that depends on the next byte too (U+00C0 to U+017F)
        self.odd = np.array([not _SPACE[b] and self.way[b] > 0 if b < 128 else 0 if b < 0xC0 else 2 if 0xC3 <= b <= 0xC5 else 1 for b in range(256)], np.uint8)
        self.store = SpanStore(self.encode_units)

    def by_library(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(units, add_special_tokens=False)]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(units)
        if not self.fast:
            return _flat(self.by_library(units))
        # a unit's way is that of its oddest character: rounds, rounds after splitting by pattern, or the library
        lengths = np.fromiter(map(len, units), np.int64, n) + 1
        codes = np.frombuffer((" ".join(units) + " ").encode("utf-32-le"), "<u4")
        way = np.maximum.reduceat(self.way[np.minimum(codes, 0x180)], np.cumsum(lengths) - lengths)
        for i in np.flatnonzero(way == 2).tolist():
            way[i] = 3 if any(t in units[i] for t in self.specials) else 1
        if not self.checked and (way < 3).any():  # hold the fast ways against the library, once a process
            self.checked = True
            some = [units[i] for i in np.flatnonzero(way < 3)[:1000].tolist()]
            flat, sizes = self._by_pattern(some)
            same = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == self.by_library(some)
            some = [units[i] for i in np.flatnonzero(way == 0)[:1000].tolist()]
            flat, sizes = self._by_class(some)
            self.fast = same and [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == (self.by_library(some) or [[]])
            if not self.fast:
                return _flat(self.by_library(units))
        if not way.any():
            return self._by_class(units)
        parts = []
        for kinds, f in (((0,), self._by_class), ((1,), self._by_pattern), ((3,), lambda x: _flat(self.by_library(x)))):
            at = np.flatnonzero(np.isin(way, kinds))
            if len(at):
                parts.append((at, *f([units[i] for i in at.tolist()])))
        sizes = np.zeros(n, np.int64)
        for at, _, size in parts:
            sizes[at] = size
        out, first = np.empty(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        for at, flat, size in parts:
            out[np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(len(flat))] = flat
        return out, sizes

    def _by_class(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units without apostrophes: tokens are runs of one class of characters, a digit being one by itself."""
        if not units:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        data = np.frombuffer((" ".join(units).lower() + " ").encode(), np.uint8)
        kind = _CLASS[data]
        start = np.ones(len(data), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        end = np.append(start[1:], True)
        unit = np.cumsum(kind == 3) - (kind == 3)
        word = kind != 3
        symbols = np.where(end, self.final[data], self.inner[data])[word]
        heads = np.flatnonzero(start[word])
        flat, sizes = merge_words(symbols, np.diff(np.append(heads, len(symbols))), self.table)
        return flat, np.bincount(unit[word][heads], sizes, len(units)).astype(np.int64)

    def _by_pattern(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not units:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        parts = [_SPLIT(u.lower()) for u in units]
        raw = [p.encode() for x in parts for p in x]
        lengths = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[data[last]]
        flat, sizes = merge_words(symbols, lengths, self.table)
        upto = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum([len(x) for x in parts]))]
        return flat, np.diff(upto)

    def spans(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes of as many, and where in them the spans lie that are encoded apart, with their lengths."""
        data = np.frombuffer(raw, np.uint8)
        if not self.fast or not raw:
            heads, stops = _units(data)
            return raw, heads, stops - heads
        flag = self.odd[data]
        two = np.flatnonzero(flag == 2)
        flag[two] = self.way[(data[two] & 0x1F).astype(np.int64) << 6 | data[two + 1] & 0x3F] > 0
        kind, low = _KIND[data], raw.lower()  # of bytes: ASCII letters only
        if flag.any():
            heads, stops = _units(data)
            own = np.maximum.reduceat(flag, heads) > 0
            if own.all():
                return raw, heads, stops - heads
            step = np.zeros(len(data) + 1, np.int8)
            step[heads[own]], step[stops[own]] = 1, -1
            whole = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
            kind, low = np.where(whole, np.uint8(4), kind), np.where(whole, data, np.frombuffer(low, np.uint8)).tobytes()
        first = np.ones(len(data), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        heads = np.flatnonzero(first)
        lengths, word = np.diff(np.append(heads, len(data))), kind[heads] != 3
        return low, heads[word], lengths[word]

    def _hold(self, raw: bytes) -> None:
        """Hold the spans of some units against the library, once a process."""
        heads, stops = _units(np.frombuffer(raw, np.uint8))
        n = min(1000, 1 + int(np.searchsorted(np.cumsum(stops - heads), 1 << 16)))
        some = [raw[a:z].decode() for a, z in zip(heads[:n].tolist(), stops[:n].tolist(), strict=True)]
        if some:
            self.held = True
            same = self.store.ids(*self.spans(" ".join(some).encode()))[0].tolist() == _flat(self.by_library(some))[0].tolist()
            if not same:
                self.fast = False
                self.store.clear()

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and each text's number of ids, with `end` after each text if given."""
        each = [t.encode() if t else b"" for t in texts]
        raw = b"\n".join([*each, b""])
        if self.fast and not self.held:
            self._hold(raw)
        raw, heads, lengths = self.spans(raw)
        flat, wide = self.store.ids(raw, heads, lengths)
        last = np.searchsorted(heads, np.cumsum([len(e) + 1 for e in each]))
        sizes = np.diff(np.append(0, np.append(0, np.cumsum(wide))[last]))
        if end is None:
            return flat, sizes
        total = sizes + 1
        ends = np.cumsum(total)
        out = np.full(int(ends[-1]) if len(ends) else 0, end, np.int32)
        inner = np.ones(len(out), bool)
        inner[ends - 1] = False
        out[inner] = flat
        return out, total


def load(data: bytes) -> WordModel:
    key = hashlib.sha256(data).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordModel(data)
    return _loaded[key]
