"""SentencePiece encoding and decoding.

A text is split into marked words: each blank becomes the mark `▁`, one mark is put before the text, and a word is a run of marks with the
characters up to the next mark. No piece of a supported model holds a mark behind another character, so words are encoded independently.

The distinct words of a slice are sorted, which lays them out as the depth-first traversal of their trie. A forward pass walks it with a stack:
going from one word to the next it keeps the states of the common prefix and computes only those of the new characters. A state
is what the best segmentation of the prefix ends with.

- Unigram models: the state is the best sum of piece scores (Viterbi), with the piece that ends there.
- BPE models: the highest sum of scores is not what the model means, its merges are. The state is the one piece with which the
  merges of the prefix end: piece t at end e, where the merges of its beginning end with p, is right exactly if the merges of p + t give p, t
  again. So the pass stays a forward pass over prefixes with one back pointer each, but admits a step by that test instead of the highest sum.

Characters without a piece become byte pieces where the model has them, else <unk>.

Defined results: null texts give null ids, null decoded text and 0 pieces; empty texts give no ids; every row is encoded, repeated
ones and ones with a null doc_id too; other columns are ignored by `encode` and `decode`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import buffer, ranges, run_hashes, sliced, strings

MODEL = os.environ.get("VELLUM_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Text bytes that are encoded at once.
SLICE_BYTES = 1 << 20
#: Distinct words that a Python worker keeps encoded.
CACHE_WORDS = 500_000
MARK = "▁"
_MARK = np.frombuffer(MARK.encode(), np.uint8)
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, np.frombuffer(data[at : at + size], np.float32 if size == 4 else np.float64)[0]
            at += size


class Model:
    """Pieces of a .model file, and the forward pass over them."""

    def __init__(self, path: str = MODEL):
        pieces, self.bpe, self.dummy, charsmap, extra = [], False, True, b"", True
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: _NORMAL} | dict(_fields(value))
                pieces.append((piece[1].decode(), float(piece[2]), piece[3]))
            elif number == 2:
                spec = dict(_fields(value))
                self.bpe = spec.get(3, 1) == 2
                if spec.get(3, 1) not in (1, 2) or spec.get(24, 0):
                    raise ValueError("only unigram and BPE models with marks before words are supported")
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.dummy, extra = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap or extra:
            raise ValueError("only models that leave texts as they are (identity, blanks kept) are supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in pieces if kind == _NORMAL):
            raise ValueError("a piece holds a mark behind another character: words would not be independent")
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [kind for _, _, kind in pieces]
        self.scores = [s for _, s, _ in pieces]
        if not pieces or pieces[0][2] not in (_UNKNOWN, _CONTROL):
            raise ValueError("only models whose piece 0 is <unk> or a control piece are supported")
        self.ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        self.unknown = next((k for k, kind in enumerate(self.kinds) if kind == _UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min((s for s, kind in zip(self.scores, self.kinds) if kind == _NORMAL), default=0.0) - 10
        self._pairs: dict[int, bool] = {}
        # lengths of the pieces that end with two given characters, longest first
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                tails.setdefault(p[-2:], set()).add(len(p))
        self.tails = {k: sorted(v, reverse=True) for k, v in tails.items()}

    def merged(self, text: str) -> list[str]:
        """BPE as defined: the pair whose union has the highest score is merged, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                piece = self.ids.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, p: int, t: int) -> bool:
        """Whether the merges of piece p followed by piece t end with t; p is 0 where t has nothing to merge with before it."""
        before, after = self.pieces[p] if p else "", self.pieces[t]
        if len(self._pairs) > 500_000:
            self._pairs.clear()
        ok = self._pairs[p << 24 | t] = self.merged(before + after) == ([before, after] if p else [after])
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted, distinct words."""
        ids, pairs, longest, bpe, tails = self.ids, self._pairs, self.longest, self.bpe, self.tails
        out, before = [], ""
        # by length of the prefix: its last piece (0 for a character that is none, and for the empty prefix), that piece's
        # length, and the score for unigram models
        last, size, score = [0], [0], [0.0]
        for word in words:
            n, same = len(word), 0
            most = min(n, len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :], size[same + 1 :]
            for end in range(same + 1, n + 1):
                found, length = ids.get(word[end - 1], 0), 1
                if bpe:
                    for k in tails.get(word[end - 2 : end] if end > 1 else "", ()):
                        if k <= end:
                            t = ids.get(word[end - k : end])
                            if t is not None:
                                p = last[end - k]
                                ok = pairs.get(p << 24 | t)
                                if ok is None:
                                    ok = self._pair(p, t)
                                if ok:
                                    found, length = t, k
                                    break
                else:
                    del score[end:]
                    best = score[end - 1] + (self.scores[found] if found else self.floor)
                    for start in range(max(0, end - longest), end - 1):
                        t = ids.get(word[start:end])
                        if t is not None and score[start] + self.scores[t] > best:
                            best, found, length = score[start] + self.scores[t], t, end - start
                    score.append(best)
                last.append(found)
                size.append(length)
            picks, end = [], n
            while end:
                piece = last[end]
                if piece:
                    picks.append(piece)
                elif self.bytes:
                    picks.extend(self.bytes[b] for b in reversed(word[end - 1].encode()))
                elif not picks or picks[-1] != self.unknown:
                    picks.append(self.unknown)
                end -= size[end]
            out.append(picks[::-1])
            before = word
        return out

    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces in text form, and their offsets."""
        number = {k: b for b, k in self.bytes.items()}
        raw = [bytes([number[k]]) if k in number else b"" if kind == _CONTROL else " ⁇ ".encode() if kind == _UNKNOWN else p.replace(MARK, " ").encode() for k, (p, kind) in enumerate(zip(self.pieces, self.kinds))]
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


class Cache:
    """Ids of words by their hash, end to end in one array."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and where their ids are found
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.base, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the hashes, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slot[at], np.int32(-1))

    def add(self, keys: np.ndarray, found: list[list[int]]) -> None:
        n, at, total = len(self.keys), self.used, sum(map(len, found))
        while len(self.flat) < at + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.base) < n + len(keys):
            self.base, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.base, self.length))
        self.flat[at : at + total] = np.fromiter((i for ids in found for i in ids), np.int32, total)
        length = np.fromiter(map(len, found), np.int64, len(found))
        self.length[n : n + len(keys)] = length
        self.base[n : n + len(keys)] = at + np.cumsum(length) - length
        self.used = at + total
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        self.keys, self.slot = every[order], np.concatenate([self.slot, np.arange(n, n + len(keys), dtype=np.int32)])[order]


_MODELS: dict[str, tuple[Model, Cache]] = {}


def _loaded(path: str) -> tuple[Model, Cache]:
    if path not in _MODELS:
        _MODELS[path] = Model(path), Cache()
    return _MODELS[path]


def encode_buffer(raw: np.ndarray, offsets: np.ndarray, valid: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and their numbers by text."""
    model, cache = _loaded(path)
    docs, size = len(offsets) - 1, np.diff(offsets)
    # blanks to marks: a mark has three bytes, and one goes before each text that is not empty
    wide = np.ones(len(raw), np.int64)
    wide[raw == 32] = 3
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(wide, out=place[1:])
    head = np.where((size > 0) & model.dummy, 3, 0)
    lead = np.cumsum(head)
    spot = place[:-1] + np.repeat(lead, size)
    marked = np.empty(int(place[-1] + head.sum()), np.uint8)
    marked[spot] = raw
    blank = spot[raw == 32]
    starts_at = place[offsets] + np.concatenate([[0], lead])
    blank = np.concatenate([blank, starts_at[:-1][head > 0]])
    for k in range(3):
        marked[blank + k] = _MARK[k]
    # a word starts at a mark that is not behind another, and with each text
    is_mark = np.zeros(len(marked), bool)
    is_mark[blank] = True
    fresh = np.zeros(len(marked) + 1, bool)
    fresh[: len(marked)] = is_mark
    after = blank + 3
    fresh[after[after < len(marked)]] &= ~is_mark[after[after < len(marked)]]
    fresh[starts_at[:-1]] = True
    begin = np.flatnonzero(fresh[: len(marked)])
    end = np.append(begin[1:], len(marked))
    if not len(begin):
        return np.zeros(0, np.int32), np.zeros(docs, np.int64)
    h = run_hashes(marked, begin, end)
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    slots = cache.find(keys)
    missing = np.flatnonzero(slots < 0)
    if len(cache.keys) + len(missing) > CACHE_WORDS:
        cache.clear()
        missing = np.arange(len(keys))
    if len(missing):
        data = marked.tobytes()
        todo = sorted((data[begin[f] : end[f]].decode(), k) for k, f in zip(missing.tolist(), first[missing].tolist()))
        cache.add(keys[[k for _, k in todo]], model.encode_words([w for w, _ in todo]))
        slots = cache.find(keys)
    index = slots[inverse]
    per_word = cache.length[index].astype(np.int64)
    ids = cache.flat[ranges(cache.base[index], per_word)]
    owner = np.searchsorted(starts_at, begin, "right") - 1
    return ids, np.bincount(owner, per_word, docs).astype(np.int64)


def decode_buffer(ids: np.ndarray, counts: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Text bytes and their numbers by text; the blank before each text is dropped."""
    model, _ = _loaded(path)
    if not hasattr(model, "_bytes"):
        model._bytes = model.piece_bytes()
    raw, offsets = model._bytes
    length = np.diff(offsets)[ids]
    out = raw[ranges(offsets[:-1][ids], length)]
    ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])]
    if model.dummy and len(out):
        starts = ends[:-1][np.diff(ends) > 0]
        drop = starts[out[starts] == 32]
        keep = np.ones(len(out), bool)
        keep[drop] = False
        out, ends = out[keep], ends - np.searchsorted(drop, ends)
    return out, np.diff(ends)


def _lists(values: np.ndarray, counts: np.ndarray, null: np.ndarray | None) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    mask = pa.array(null) if null is not None and null.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=mask)


def _text(raw: np.ndarray, lengths: np.ndarray, null: np.ndarray) -> pa.Array:
    import pyarrow.compute as pc

    try:
        text = strings(raw, lengths)
        text.validate(full=True)
    except pa.ArrowInvalid:  # ids that are no UTF-8 text
        data, ends = raw.tobytes(), np.cumsum(lengths)
        text = pa.array([data[e - n : e].decode(errors="replace") for e, n in zip(ends.tolist(), lengths.tolist())], pa.string())
    return pc.if_else(pa.array(~null), text, pa.scalar(None, pa.string())) if null.any() else text


def encode(docs: DataFrame, model: str = MODEL, decoded: bool = False) -> DataFrame:
    """Rows (doc_id, n_pieces, ids), and with `decoded` the text that the ids decode to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=SLICE_BYTES):
            raw, offsets = buffer(batch.column(1))
            null = ~batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            ids, counts = encode_buffer(raw, offsets, ~null, model)
            columns, names = [batch.column(0), pa.array(counts), _lists(ids, counts, null)], ["doc_id", "n_pieces", "ids"]
            if decoded:
                columns.append(_text(*decode_buffer(ids, counts, model), null))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_pieces long, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            null = ~lists.is_valid().to_numpy(zero_copy_only=False)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), _text(*decode_buffer(ids, counts, model), null)], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(work, "doc_id long, text string")
