"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces walks a text once; at every position
its output links give the pieces that end there, and each relaxes the best path
to that position (a Viterbi pass over the piece lattice).

For a unigram model a path scores the sum of its pieces. For a BPE model the
score of a step is 0 when byte-pair merging leaves the two pieces side by side
and minus infinity when it would merge across them, so exactly one path
survives: the one merging gives. Characters without a piece become byte pieces,
or the unknown piece when the model has none.

A model's character map and white-space rules are applied first; decoding gives the
normalized text back. Models that mark words at their ends are refused.

Texts are cut between characters that stand side by side in no piece, which no piece
or merge can reach across, so equal units are solved once while remembered: texts are
cut, looked up and put together in arrays, and the memo holds at most `MEMO` units.

Defined cases: null or empty text has no ids; long texts are walked unit by
unit; a text that itself holds the word mark decodes to a space there.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .idmemo import IdMemo
from .memory import small_batches

MARK = "▁"
MEMO, PAIRS, PART = 1_000_000, 300_000, 1 << 21
# Model and piece types of the public model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, data[at:at + size]
        at += size


class Normalizer:
    """A model's character map, a trie of UTF-8 strings with their replacements: at each
    place the longest string that is in it is replaced, other characters stay. With
    `squeeze`, spaces at both ends go and runs of spaces become one. Symbols stay as they are.

    The trie is a double array of 32-bit units in the public format: a unit holds the byte
    that leads to it, whether a string ends there, and how far its children are."""

    def __init__(self, charsmap: bytes, squeeze: bool, symbols: list[str]):
        size = struct.unpack("<I", charsmap[:4])[0] if charsmap else 0
        self.trie = np.frombuffer(charsmap[4:4 + size], "<u4").tolist()
        self.targets, self.squeeze = charsmap[4 + size:], squeeze
        self.symbols = re.compile("|".join(map(re.escape, sorted(symbols, key=len, reverse=True)))) if symbols else None

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _longest(self, raw: bytes) -> tuple[int, str] | None:
        """(bytes, replacement) of the longest string of the map that `raw` starts with."""
        found = None
        if not self.trie:
            return found
        node = self._children(self.trie[0])
        for n, byte in enumerate(raw, 1):
            node ^= byte
            unit = self.trie[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._children(unit)
            if unit >> 8 & 1:
                at = self.trie[node] & 0x7FFFFFFF
                found = n, self.targets[at:self.targets.index(b"\0", at)].decode("utf-8", "replace")
        return found

    def _steps(self, text: str) -> Iterator[str]:
        raw, at, k = text.encode("utf-8", "replace"), 0, 0
        while at < len(raw):
            held = self.symbols and self.symbols.match(text, k)
            if held and held.end() > k:
                yield held[0]
                at, k = at + len(held[0].encode()), held.end()
                continue
            found = self._longest(raw[at:at + 64])  # longer than any string of a map
            if found:
                k += len(raw[at:at + found[0]].decode())
                at += found[0]
                yield found[1]
            else:
                yield text[k]
                at, k = at + len(text[k].encode("utf-8", "replace")), k + 1

    def __call__(self, text: str) -> str:
        out, space = [], self.squeeze
        for step in self._steps(text):
            if space:
                step = step.lstrip(" ")
            if step:
                out.append(step)
                space = self.squeeze and step.endswith(" ")
        whole = "".join(out)
        return whole.rstrip(" ") if self.squeeze else whole


class Codec:
    """A model file's pieces with encode and decode."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._load(f.read())

    def _load(self, model: bytes) -> None:
        self.kind, self.prefix, self.squeeze, charsmap = UNIGRAM, True, True, b""
        rows: list[tuple[str, float, int]] = []
        for number, value in _fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                rows.append((piece, score, kind))
            elif number == 2:
                self.kind = next((v for n, v in _fields(value) if n == 3), UNIGRAM)
                if next((v for n, v in _fields(value) if n == 24), 0):
                    raise ValueError("models that mark words at their ends are not read")
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix, self.squeeze, charsmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
                if not spec.get(5, 1):
                    raise ValueError("models that leave spaces as they are are not read")
        symbols = [p for p, _, k in rows if k == USER]
        self.normalize = Normalizer(charsmap, self.squeeze, symbols) if charsmap or self.squeeze else None
        self.rows = rows
        self.unknown = next((i for i, r in enumerate(rows) if r[2] == UNKNOWN), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(rows) if k == BYTE}
        words = {p: i for i, (p, _, k) in enumerate(rows) if k in (NORMAL, USER)}
        self.score = [s for _, s, _ in rows]
        self.ids, self.floor = words, min((rows[i][1] for i in words.values()), default=0.0) - 10.0
        if self.kind == BPE:
            self._merges(words)
        self.automaton = ahocorasick.Automaton()
        for p, i in words.items():
            if self.kind != BPE or i in self.right:
                self.automaton.add_word(p, (i, len(p)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, _, k in rows]
        self.memo = IdMemo(MEMO)
        self.pair_memo: dict[int, bool] = {}
        self.pairs = {p[k:k + 2] for p in words for k in range(len(p) - 1)}
        # Number of each character that stands beside another one in a piece, and a table of the pairs that do.
        inner = sorted({c for pair in self.pairs for c in pair})
        self.number = np.zeros(0x110000, np.uint16 if len(inner) < 1 << 16 else np.uint32)
        self.number[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.wide = len(inner) + 1
        flat = [int(self.number[ord(x)]) * self.wide + int(self.number[ord(y)]) for x, y in self.pairs]
        if self.wide <= 1 << 13:
            self.glued = np.zeros(self.wide**2, bool)
            self.glued[flat] = True
        else:
            self.glued = None
            self.sorted_pairs = np.sort(np.array(flat, np.int64))

    def _merges(self, words: dict[str, int]) -> None:
        """For each piece that merging can make: its boundary pieces over time, as
        lists of (piece, score at which the next one replaces it)."""
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        for p, i in sorted(words.items(), key=lambda x: len(x[0])):
            if len(p) == 1:
                self.right[i] = self.left[i] = [(i, -np.inf)]
                continue
            last = self._merge_down(p)
            if last is None:
                continue
            a, b = last
            if a in self.left and b in self.right:
                self.left[i] = [*self.left[a][:-1], (a, self.score[i]), (i, -np.inf)]
                self.right[i] = [*self.right[b][:-1], (b, self.score[i]), (i, -np.inf)]

    def _merge_down(self, p: str) -> tuple[int, int] | None:
        """The last merge that makes p from its characters; None if merging stops short."""
        parts, last = list(p), None
        while len(parts) > 1:
            best = max(((self.score[self.ids[x + y]], -k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.ids), default=None)
            if best is None:
                return None
            k = -best[1]
            last = (self.ids.get(parts[k]), self.ids.get(parts[k + 1]))
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return last

    def _stands(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b apart: at each moment the two boundary
        pieces must not merge before one of them is replaced. Equal scores go left first."""
        key = a << 32 | b
        known = self.pair_memo.get(key)
        if known is not None:
            return known
        xs, ys, i, j, out = self.right[a], self.left[b], 0, 0, True
        rows, ids, score = self.rows, self.ids, self.score
        while True:
            x, sx = xs[i]
            y, sy = ys[j]
            both = ids.get(rows[x][0] + rows[y][0])
            if both is not None:
                s = score[both]
                if s > sx and s >= sy:
                    out = False
                    break
            if sx == -np.inf and sy == -np.inf:
                break
            if sx >= sy:
                i += 1
            else:
                j += 1
        if len(self.pair_memo) >= PAIRS:
            self.pair_memo.clear()
        self.pair_memo[key] = out
        return out

    def _solve(self, unit: str) -> bytes:
        """Ids of one unit as little-endian unsigned 32-bit integers."""
        n = len(unit)
        piece: list[int | None] = [None] * (n + 1)  # last piece of the best path to each position; -1: no piece
        start = [0] * (n + 1)
        (self._relax_merges if self.kind == BPE else self._relax_scores)(unit, piece, start)
        out: list[int] = []
        at = n
        while at:
            if piece[at] == -1:
                raw = unit[start[at]:at].encode("utf-8", "surrogatepass")
                out += [self.byte_ids[b] for b in reversed(raw)] if self.byte_ids else [self.unknown]
            else:
                out.append(piece[at])
            at = start[at]
        return struct.pack(f"<{len(out)}I", *out[::-1])

    def _relax_merges(self, unit: str, piece: list, start: list) -> None:
        """One path survives at each position: the piece that stands beside the
        last piece of the prefix before it."""
        bare = [k for k, x in enumerate(unit) if x not in self.ids]
        for k in bare:  # nothing merges with a character that has no piece
            piece[k + 1], start[k + 1] = -1, k
        memo, stands = self.pair_memo, self._stands
        for end, (i, size) in self.automaton.iter(unit):
            if piece[end + 1] is None:
                s = end + 1 - size
                a = piece[s]
                if a is None:
                    if s:
                        continue
                elif a >= 0:
                    ok = memo.get(a << 32 | i)
                    if not (stands(a, i) if ok is None else ok):
                        continue
                piece[end + 1], start[end + 1] = i, s

    def _relax_scores(self, unit: str, piece: list, start: list) -> None:
        best = [-np.inf] * (len(unit) + 1)
        best[0], done = 0.0, 0

        def bare(upto: int) -> None:
            """Characters without a piece of their own step alone."""
            nonlocal done
            for k in range(done, upto):
                if unit[k] not in self.ids and best[k] + self.floor > best[k + 1]:
                    best[k + 1], start[k + 1], piece[k + 1] = best[k] + self.floor, k, -1
            done = max(done, upto)

        for end, (i, size) in self.automaton.iter(unit) if len(self.automaton) else ():
            bare(end)
            s, e = end + 1 - size, end + 1
            total = best[s] + self.score[i]
            if total > best[e]:
                best[e], start[e], piece[e] = total, s, i
        bare(len(unit))

    def _units(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of the units of texts that lie back to back, as code points."""
        number = self.number[codes].astype(np.int32 if self.wide < 1 << 15 else np.int64)
        pair = number[:-1] * self.wide + number[1:]
        if self.glued is not None:
            together = self.glued[pair]
        else:
            at = np.minimum(np.searchsorted(self.sorted_pairs, pair), max(0, len(self.sorted_pairs) - 1))
            together = self.sorted_pairs[at] == pair
        start = np.r_[True, ~together]
        start[ends[:-1]] = True
        return np.flatnonzero(start)

    def _parts(self, text: str) -> Iterator[str]:
        """A long text cut between units."""
        at = 0
        while len(text) - at > PART:
            cut = next((k for k in range(at + PART, at, -1) if text[k - 1:k + 1] not in self.pairs), len(text))
            yield text[at:cut]
            at = cut
        if at < len(text):
            yield text[at:]

    def _solved(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._solve(u.decode("utf-8", "surrogatepass")) for u in units]
        return np.fromiter(map(len, found), np.int64, len(found)) // 4, np.frombuffer(b"".join(found), "<u4")

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []

        def settle() -> None:
            joined = "".join([p for _, p in waiting])
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.cumsum([len(p) for _, p in waiting])
            starts = self._units(codes, ends)
            size = np.ones(len(codes), np.int8)
            for least in (0x80, 0x800, 0x10000):
                size += codes >= least
            place = np.cumsum(size, dtype=np.int32) - size
            ids, n = self.memo.ids(joined.encode("utf-8", "surrogatepass"), place[starts], self._solved)
            upto = np.cumsum(n, dtype=np.int64)[np.searchsorted(starts, ends) - 1].tolist()
            for (i, _), a, b in zip(waiting, [0, *upto], upto):
                out[i].append(ids[a:b])
            waiting.clear()

        held = 0
        for i, text in enumerate(texts):
            if text and self.normalize:
                text = self.normalize(text)
            if not text:
                continue
            for part in self._parts((MARK if self.prefix else "") + text.replace(" ", MARK)):
                waiting.append((i, part))
                held += len(part)
                if held >= PART:
                    settle()
                    held = 0
        if waiting:
            settle()
        whole = [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]
        if self.byte_ids:
            return whole
        # Without byte pieces, characters side by side that have no piece are one unknown piece.
        return [x[~((x == self.unknown) & (np.r_[~x[:1], x[:-1]] == self.unknown))] for x in whole]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the word mark put before the text is dropped."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                found = c.encode_all(batch.column(1).to_pylist())
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for every row of tokens(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = [c.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, n_chars, decoded_equal): encodes every whole
    text, decodes the ids and compares with the text, normalized if the model does that;
    null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, len(whole), 1024)):
            out = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for text, ids in zip(texts, c.encode_all(texts)):
                back = c.decode(ids)
                text = c.normalize(text) if c.normalize else text
                out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(back), back == text))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in cols[:3]], pa.array(cols[3], pa.bool_())],
                ["doc_id", "n_pieces", "ids_crc32", "n_chars", "decoded_equal"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_chars long, decoded_equal boolean")
