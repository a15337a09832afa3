"""Encoding with SentencePiece vocabularies: unigram Viterbi over a double-array trie, and decoding.

Scores are those of the vocabulary's file. For unigram vocabularies these are log probabilities, and ids are those of the vocabulary's own
library. A file of merges (model type BPE) holds ranks instead, as negative numbers: Viterbi then finds the segmentation with the least sum
of ranks, which decodes to the same text but is not always the one that the merges give.

The trie is built once on the driver and broadcast as two integer arrays. No piece of the usual vocabularies has a white-space marker
after another character, so texts split exactly before each run of markers; distinct segments are encoded once per worker, many of one
length at a time, with array operations over all of them.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import mapped

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: How much worse than the worst piece a character is that no piece covers.
_PENALTY = 10.0
_NEVER = -1e300


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message; values are ints or bytes."""
    at = 0

    def varint():
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
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class DoubleArray:
    """A trie over bytes: the child of state s by byte c is base[s] + c + 1 if check of that is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        todo, start = [(0, 0, len(keys), 0)], 1
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[lo]) == depth:
                value[state] = values[lo]
                lo += 1
            children, at = [], lo
            while at < hi:
                c, first = keys[at][depth], at
                while at < hi and keys[at][depth] == c:
                    at += 1
                children.append((c, first, at))
            if not children:
                continue
            labels = [c + 1 for c, _, _ in children]
            at, taken = max(start, labels[0] + 1), 0
            first = at
            while True:
                if at + 257 >= len(check):
                    more = len(check)
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                if check[at] >= 0:
                    taken += 1
                elif all(check[at - labels[0] + c] < 0 for c in labels[1:]):
                    break
                at += 1
            if taken > 0.95 * (at - first + 1):
                start = at  # what lies before is as good as full
            b = at - labels[0]
            base[state] = b
            for c, first, last in children:
                check[b + c + 1] = state
                todo.append((b + c + 1, first, last, depth + 1))
        self.base, self.check, self.value = (np.array(x, dtype=np.int32) for x in (base, check, value))

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each state by each byte; -1 where there is none."""
        to = self.base[states] + codes + 1
        return np.where((self.base[states] > 0) & (self.check[to] == states), to, -1)

    def prefixes(self, text: bytes, at: int):
        """(end, value) of each key that text has at this place."""
        state = 0
        for end in range(at, len(text)):
            b = int(self.base[state])
            to = b + text[end] + 1
            if not b or self.check[to] != state:
                return
            state = to
            if self.value[state] >= 0:
                yield end + 1, int(self.value[state])


class SegmentCache:
    """Segments that were encoded before: their place in one array of ids."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.place = most, {}
        self.ids, self.used = np.empty(1 << 16, dtype=np.int32), 0
        self.starts, self.sizes = np.empty(1 << 14, dtype=np.int64), np.empty(1 << 14, dtype=np.int32)

    def clear(self) -> None:
        self.place.clear()
        self.used = 0

    def add(self, segments: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self.place)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while known + len(segments) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[known : known + len(segments)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[known : known + len(segments)] = sizes
        self.used += len(ids)
        self.place.update(zip(segments, range(known, known + len(segments))))

    def get(self, segments: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.place.__getitem__, segments), dtype=np.int64, count=len(segments))
        return gathered(self.ids, self.starts[at], self.sizes[at])


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at starts, one after the other."""
    before = np.cumsum(sizes, dtype=np.int64) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


@dataclass
class Pieces:
    """A vocabulary, ready to encode and decode."""

    pieces: list[str]
    kinds: list[int]
    scores: np.ndarray
    trie: DoubleArray
    byte_ids: np.ndarray  # id of each byte's piece, or -1
    unknown_id: int
    dummy_prefix: bool
    squeeze: bool
    longest: int
    segmented: bool
    unknown_score: float
    texts: np.ndarray  # what each piece stands for, end to end, and where each begins
    text_starts: np.ndarray
    cache: SegmentCache | None = None

    @classmethod
    def load(cls, path: str) -> Pieces:
        with open(path, "rb") as file:
            return cls.parse(file.read())

    @classmethod
    def parse(cls, model: bytes) -> Pieces:
        rows, dummy, squeeze = [], True, True
        for number, value in _fields(model):
            if number == 1:
                part = dict(_fields(value))
                rows.append((part[1].decode(), float(np.frombuffer(part.get(2, bytes(4)), "<f4")[0]), part.get(3, _NORMAL)))
            elif number == 3:
                part = dict(_fields(value))
                dummy, squeeze = bool(part.get(3, 1)), bool(part.get(4, 1))
                if part.get(2):
                    raise NotImplementedError("a vocabulary with its own character map")
        return cls.build(rows, dummy, squeeze)

    @classmethod
    def build(cls, rows: list[tuple[str, float, int]], dummy_prefix: bool = True, squeeze: bool = False) -> Pieces:
        own = [i for i, (p, _, kind) in enumerate(rows) if kind in (_NORMAL, _USER) and p]
        keys = [rows[i][0].encode() for i in own]
        byte_ids = np.full(256, -1, dtype=np.int32)
        for i, (p, _, kind) in enumerate(rows):
            if kind == _BYTE:
                byte_ids[int(p[1:-1], 16)] = i
        unknown = next((i for i, r in enumerate(rows) if r[2] == _UNKNOWN), 0)
        within = any(MARK in rows[i][0].lstrip(MARK) for i in own)
        worst = min((s for _, s, kind in rows if kind == _NORMAL), default=0.0) - _PENALTY
        stands_for = [{_BYTE: lambda p: bytes([int(p[1:-1], 16)]), _UNKNOWN: lambda _: " ⁇ ".encode(), _CONTROL: lambda _: b""}.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, _, kind in rows]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in stands_for])])
        texts = np.frombuffer(b"".join(stands_for), np.uint8)
        longest = max(map(len, keys), default=1)
        return cls([r[0] for r in rows], [r[2] for r in rows], np.array([r[1] for r in rows]), DoubleArray(keys, own), byte_ids, unknown, dummy_prefix, squeeze, longest, not within, worst, texts, starts)

    def __getstate__(self):
        return self.__dict__ | {"cache": None}

    def _fallback(self, char: bytes) -> list[int]:
        ids = [int(self.byte_ids[b]) for b in char]
        return ids if min(ids) >= 0 else [self.unknown_id]

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (" " * self.dummy_prefix + text).replace(" ", MARK)

    def viterbi(self, segment: bytes) -> list[int]:
        """The segmentation with the largest sum of scores; of equal ones that with the longest last piece."""
        best, back = [0.0] + [_NEVER] * len(segment), [(0, -1)] * (len(segment) + 1)
        unknown = self.unknown_score
        at = 0
        while at < len(segment):
            for end, piece in self.trie.prefixes(segment, at):
                if best[at] + self.scores[piece] > best[end]:
                    best[end], back[end] = best[at] + self.scores[piece], (at, piece)
            step = 1
            while at + step < len(segment) and segment[at + step] & 0xC0 == 0x80:
                step += 1
            if best[at] + unknown > best[at + step]:
                best[at + step], back[at + step] = best[at] + unknown, (at, -1)
            at += step
        out, at = [], len(segment)
        while at:
            before, piece = back[at]
            out.append([piece] if piece >= 0 else self._fallback(segment[before:at]))
            at = before
        return [i for part in reversed(out) for i in part]

    def viterbi_many(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """viterbi of each of several segments of one length, all at once: ids end to end, and how many each has."""
        n, length = len(segments), len(segments[0])
        codes = np.frombuffer(b"".join(segments), np.uint8).reshape(n, length).astype(np.int32)
        best = np.full((n, length + 1), _NEVER)
        best[:, 0] = 0
        origin = np.zeros((n, length + 1), dtype=np.int32)
        chosen = np.full((n, length + 1), -1, dtype=np.int32)
        lead = np.ones((n, length + 1), dtype=bool)
        lead[:, :length] = codes & 0xC0 != 0x80
        unknown = self.unknown_score
        for at in range(length):
            rows = np.flatnonzero(lead[:, at])
            states, live = np.zeros(len(rows), dtype=np.int32), rows
            for end in range(at + 1, min(length, at + self.longest) + 1):
                states = self.trie.step(states, codes[live, end - 1])
                on = states >= 0
                live, states = live[on], states[on]
                if not len(live):
                    break
                piece = self.trie.value[states]
                full = piece >= 0
                hit, own = live[full], piece[full]
                score = best[hit, at] + self.scores[own]
                up = score > best[hit, end]
                hit, own = hit[up], own[up]
                best[hit, end], origin[hit, end], chosen[hit, end] = score[up], at, own
            ends = at + 1 + np.argmax(lead[rows, at + 1 :], axis=1)
            score = best[rows, at] + unknown
            up = score > best[rows, ends]
            hit, ends = rows[up], ends[up]
            best[hit, ends], origin[hit, ends], chosen[hit, ends] = score[up], at, -1
        rows, at, found = np.arange(n), np.full(n, length), []
        while len(rows):
            before, piece = origin[rows, at], chosen[rows, at]
            known = piece >= 0
            found.append((rows[known], before[known], piece[known]))
            for r, lo, hi in zip(rows[~known], before[~known], at[~known]):
                ids = self._fallback(segments[r][lo:hi])
                found.append((np.full(len(ids), r), lo + np.arange(len(ids)), np.array(ids, dtype=np.int32)))
            rows, at = rows[before > 0], before[before > 0]
        rows, places, ids = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(rows * (length + 1) + places, kind="stable")
        return ids[order], np.bincount(rows, minlength=n)

    def _remember(self, segments: list[str]) -> None:
        cache = self.cache
        by_length: dict[int, list[str]] = {}
        for s in segments:
            if s not in cache.place:
                by_length.setdefault(len(s) if s.isascii() else len(s.encode(errors="replace")), []).append(s)
        for length, group in by_length.items():
            many = max(1, 200_000 // length)
            for at in range(0, len(group), many):
                part = group[at : at + many]
                raw = [s.encode(errors="replace") for s in part]
                if len(raw) > 3 and length <= 256:
                    cache.add(part, *self.viterbi_many(raw))
                else:
                    ids = [self.viterbi(r) for r in raw]
                    cache.add(part, np.array([i for x in ids for i in x], dtype=np.int32), np.array([len(x) for x in ids], dtype=np.int64))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.cache is None:
            self.cache = SegmentCache()
        pattern = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        out: list[np.ndarray] = []
        held: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            whole = self.normalised(text or "")
            held.append(pattern.findall(whole) if self.segmented else [whole] * bool(whole))
            size += len(held[-1])
            if size >= 200_000 or i == len(texts) - 1:  # what one round needs is in the cache together
                if len(self.cache.place) > self.cache.most:
                    self.cache.clear()
                self._remember(list(dict.fromkeys(s for segments in held for s in segments)))
                out += map(self.cache.get, held)
                held, size = [], 0
        return out

    def decode(self, ids) -> str:
        """The text: bytes of byte pieces join, markers become spaces, the dummy prefix goes; invalid bytes are replaced."""
        ids = np.asarray(ids, dtype=np.int64)
        text = gathered(self.texts, self.text_starts[ids], self.text_starts[ids + 1] - self.text_starts[ids]).tobytes().decode(errors="replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _applied(df: DataFrame, col: str, id_col: str, model: Pieces, function, schema: str) -> DataFrame:
    """doc_id and what function makes of the values of col; schema is of that alone."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                names, arrays = function(shared.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", *names])

    return mapped(df.select(F.col(id_col).alias("doc_id"), F.col(col).alias("v")), run, f"doc_id {kind}, {schema}")


def encode(documents: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: each text's piece ids.

    Defined cases: null and empty texts have no ids. Characters that no piece covers become their UTF-8 bytes' pieces (the unknown piece if
    the vocabulary has none). Repeated rows are returned each; an empty table gives no rows; other columns are ignored.
    """
    return _applied(documents, text_col, id_col, model, lambda m, texts: (["ids"], [pa.array(m.encode_batch(texts), pa.list_(pa.int32()))]), "ids array<int>")


def decode(encoded: DataFrame, model: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts of lists of piece ids; null and empty lists give an empty text. U+2581 within a text comes back as a space."""
    return _applied(encoded, ids_col, id_col, model, lambda m, lists: (["text"], [pa.array([m.decode(x or []) for x in lists], pa.string())]), "text string")


def round_trips(documents: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text back.

    Defined cases: null and empty texts have no pieces and come back as empty (round_trip is true); texts with U+2581 come back with
    spaces in its place, and so do, where the vocabulary squeezes white space, texts without what it squeezes (round_trip is false). Null
    ids and repeated rows are returned like any; an empty table gives no rows; other columns are ignored.
    """

    def digest(m: Pieces, texts):
        ids = m.encode_batch(texts)
        is_byte = np.array([k == _BYTE for k in m.kinds])
        back = [m.decode(x) == (t or "") for x, t in zip(ids, texts)]
        columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64())]
        return ["n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"], [*columns, pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(back, pa.bool_())]

    return _applied(documents, text_col, id_col, model, digest, "n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")


def op6_sentencepiece(spark, sf_dir):
    import public_tokenizers

    model = Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)
