"""Benchmark decontamination by the q-gram lemma.

A passage of n characters that occurs with at most k edits shares at least
n + 1 - q - q*k of its q-grams with the place where it occurs, and those hits lie
on diagonals (position in the text less position in the passage) at most k
apart. Hits are counted in overlapping diagonal bands of 2k + 1, one starting
every k + 1 diagonals, so that any k + 1 neighbouring diagonals lie in one band.
Bands that reach the bound are verified by alignment in the band alone; all
regions within the budget that do not overlap are found, the best ones first.

The budget k is a tenth of the passage's characters, rounded down, whatever its
length. Grams have 8 characters; a passage for which the lemma would then ask for
no shared gram has shorter ones, of n // (k + 1) characters: so passages of under
10 characters, which have no budget, are found by exact occurrence.

Texts are compared in lower case with every white-space character as a space;
both keep the length, so positions are those of the text.

Texts are hashed many at a time. A band has no more hits than its passage has in
the whole text, so hits of a passage that has fewer than the bound there are put
aside before bands are counted. Hits are listed for a bounded number at a time and
kept as counts by band, so a text and a passage that repeat one character take
memory in proportion to the text. The passages are shared with all tasks in blocks
of at most `block_chars` characters; a larger benchmark takes more passes, each
exact.

Defined cases: null and empty texts and passages match nothing; equal rows match
alike; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import give_back, small_batches

Q, EDITS = 8, 0.1
#: A character no text has; edits in a cell of the alignment table; no way; cells of one table; hits at a time.
OUTSIDE, UNIT, FAR, CELLS, HITS = 0xFFFFFFFF, 1 << 32, 1 << 60, 1 << 20, 1 << 20
#: Characters of the texts that are searched together, and of those that are hashed together.
GROUP, CHUNK = 1 << 20, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r\x85\xa0  　"})


def normalize(text: str | None) -> str:
    t = (text or "").translate(_SPACES)
    low = t.lower()
    return low if len(low) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def _plain() -> np.ndarray:
    """What normalize() makes of each character, OUTSIDE where that hangs on others or is not one character."""
    table = np.arange(0x110000, dtype=np.uint32)
    rest = table[0x20000:].tobytes().decode("utf-32-le")
    for c in range(0x20000 if rest.lower() == rest else len(table)):
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else OUTSIDE
    table[ord("Σ")] = OUTSIDE  # lower case differs at a word's end
    table[list(_SPACES)] = ord(" ")
    return table


def _together(texts: list[str]) -> np.ndarray:
    """The codes of the normalized texts, one behind the other."""
    codes, table = _codes("".join(texts)), _plain()
    out = np.empty_like(codes)
    for at in range(0, len(codes), CHUNK):
        table.take(codes[at:at + CHUNK], out=out[at:at + CHUNK], mode="clip")
    odd = np.flatnonzero(out == OUTSIDE)
    if len(odd):
        ends = np.cumsum([len(t) for t in texts])
        for t in np.unique(np.searchsorted(ends, odd, "right")).tolist():
            out[ends[t] - len(texts[t]):ends[t]] = _codes(normalize(texts[t]))
    return out


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomials of q codes each, from those of half as many, mixed."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    h, m = wide, 1
    for bit in f"{q:b}"[1:]:
        h = h[:len(h) - m] * np.uint64(pow(int(_BASE), m, 1 << 64)) + h[m:]
        m *= 2
        if bit == "1":
            h = h[:-1] * _BASE + wide[m:]
            m += 1
    h ^= h >> np.uint64(31)
    h *= _BASE
    return h


def apart(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, start, end) the first in order, and on those that overlap none taken."""
    taken: list[tuple[int, int]] = []
    out = []
    for edits, start, end in sorted(hits):
        at = bisect_left(taken, (end, 0))
        if at and taken[at - 1][1] > start:
            continue
        taken.insert(at, (start, end))
        out.append((edits, start, end))
    return out


def _groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in turn, in lists of at most GROUP characters or of one text that has more."""
    group: list[str] = []
    held = 0
    for text in texts:
        if group and (held + len(text or "") > GROUP or len(group) >= 4096):
            yield group
            group, held = [], 0
        group.append(text or "")
        held += len(group[-1])
    if group:
        yield group


class _Grams:
    """The q-grams of some passages, for one q."""

    SIEVE = 22

    def __init__(self, which: list[int], codes: list[np.ndarray], q: int):
        self.q = q
        hashes = [gram_hashes(codes[i], q) for i in which]
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        self.grams, self.first, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.array(which), [len(h) for h in hashes])[order]
        self.place = np.concatenate([np.arange(len(h)) for h in hashes])[order]
        self.sieve = np.zeros(1 << self.SIEVE, bool)
        self.sieve[self.grams >> np.uint64(64 - self.SIEVE)] = True
        # The first gram of each run of equal leading bits; behind the last gram one that nothing exceeds.
        bits = min(self.SIEVE, len(self.grams).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.grams, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.ended = np.r_[self.grams, np.uint64(0xFFFFFFFFFFFFFFFF)]

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the gram) of the grams found in the codes."""
        places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, max(1, len(codes) - self.q + 1), CHUNK):
            h = gram_hashes(codes[at:at + CHUNK + self.q - 1], self.q)
            pos = np.flatnonzero(self.sieve.take((h >> np.uint64(64 - self.SIEVE)).view(np.int64)))
            h = h[pos]
            found = self.begin.take((h >> self.shift).view(np.int64))
            less = np.flatnonzero(self.ended.take(found) < h)
            while len(less):
                found[less] += 1
                less = less[self.ended.take(found[less]) < h[less]]
            good = np.flatnonzero((self.ended.take(found) == h) & (found < len(self.grams)))
            places.append(pos[good] + at)
            numbers.append(found[good])
        return np.concatenate(places), np.concatenate(numbers)

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, diagonal) of all hits in a text, about HITS at a time."""
        for at in range(0, max(1, len(codes) - self.q + 1), 1 << 20):
            pos, found = self.find(codes[at:at + (1 << 20) + self.q - 1])
            if not len(pos):
                continue
            upto = np.cumsum(self.counts[found])
            cut = 0
            while cut < len(pos):
                end = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + HITS, "right")))
                f, p = found[cut:end], pos[cut:end]
                n = self.counts[f]
                which = np.repeat(self.first[f] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                yield self.item[which], np.repeat(p + at, n) - self.place[which]
                cut = end


class Passages:
    """Index of the q-grams of some passages."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edits: float = EDITS):
        rows = [(item, codes) for item, text in items if len(codes := _codes(normalize(text)))]
        self.ids = [i for i, _ in rows]
        self.codes = [c for _, c in rows]
        n = np.array([len(c) for c in self.codes], np.int64)
        self.budget = (n * edits).astype(np.int64)
        # Grams for which the lemma still asks for one that is shared.
        grams = np.minimum(q, n // (self.budget + 1))
        self.bound = n + 1 - grams - grams * self.budget
        self.parts = [_Grams(np.flatnonzero(grams == g).tolist(), self.codes, int(g)) for g in np.unique(grams)]
        self.memo: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        self.memo_bytes = 0

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) of one text whose hits reach the bound."""
        wide = 1 << 40
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def together() -> tuple[np.ndarray, np.ndarray]:
            all_keys = np.concatenate(keys)
            if len(keys) == 2:  # one listing: its keys are unique
                return all_keys, np.concatenate(counts)
            found, at = np.unique(all_keys, return_inverse=True)
            return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)

        for part in self.parts:
            for item, diagonal in part.hits(codes):
                low = diagonal // (self.budget[item] + 1)
                mine, times = np.unique(item * wide + low + (wide >> 1), return_counts=True)
                keys.append(mine)
                counts.append(times)
                held += len(mine)
                if held > HITS:
                    found, total = together()
                    keys, counts, held = [found[:0], found], [total[:0], total], 0
        return self._full(*together())

    def _full(self, found: np.ndarray, total: np.ndarray, items: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number, band) of the bands that reach the bound: a step of k + 1 diagonals is
        number << 40 plus its place plus 1 << 39, a band holds two neighbouring steps;
        the number is that of an item, or of a place in items."""
        wide = 1 << 40
        both = np.sort(np.concatenate([found, found - 1]), kind="stable")  # two sorted runs
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both

        def of(step: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(found, step), max(0, len(found) - 1))
            return np.where(found[at] == step, total[at], 0) if len(found) else np.zeros(len(step), np.int64)

        number = both // wide
        bound = self.bound[number if items is None else items[number]]
        enough = of(both) + of(both + 1) >= bound if len(both) else np.zeros(0, bool)
        return number[enough], both[enough] % wide - (wide >> 1)

    def bands_of_many(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, band) as of bands(), in order, for texts that end at these places of the codes."""
        found = []
        edges, each = np.r_[0, ends], np.zeros(len(ends) + 1, np.int64)
        for part in self.parts:
            pos, gram = part.find(codes)
            text = np.searchsorted(ends, pos, "right")
            whole = np.flatnonzero(pos + part.q <= ends[text])
            pos, gram, text = pos[whole], gram[whole], text[whole]
            each += np.r_[0, np.cumsum(part.counts[gram])][np.searchsorted(text, np.arange(len(ends) + 1))]
            found.append((part, pos, gram, text))
        out = []
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(each, each[a] + HITS, "right")) - 1)
            if each[b] - each[a] > HITS:
                item, band = self.bands(codes[edges[a]:edges[b]])
                out.append((np.full(len(item), a), item, band))
            elif each[b] > each[a]:
                out.append(self._bands_of_run(found, edges, a, b))
            a = b
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def _bands_of_run(self, found: list[tuple[_Grams, np.ndarray, np.ndarray, np.ndarray]], edges: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """bands_of_many() of texts a to b, which have at most HITS hits, from (grams, place, number of the gram, text)."""
        pairs, places = [], []
        for part, *of in found:
            begin, end = np.searchsorted(of[2], (a, b))
            pos, gram, text = (x[begin:end] for x in of)
            n = part.counts[gram]
            which = np.repeat(part.first[gram] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            item = part.item[which]
            pair = np.repeat(text * len(self.codes), n) + item
            # Pairs may share a count: those that reach the bound stay all the same.
            slot = pair & ((1 << (4 * len(pair) | 0xFFFF).bit_length()) - 1)
            stay = np.flatnonzero(np.bincount(slot)[slot] >= self.bound[item])
            pairs.append(pair[stay])
            places.append(np.repeat(pos - edges[text], n)[stay] - part.place[which[stay]])
        pair, number = np.unique(np.concatenate(pairs), return_inverse=True)
        items = pair % max(1, len(self.codes))
        step = np.concatenate(places) // (self.budget[items] + 1)[number]
        number, band = self._full(*np.unique((number << 40) + step + (1 << 39), return_counts=True), items)
        return pair[number] // max(1, len(self.codes)), items[number], band

    def _candidates(self, codes: np.ndarray, items: np.ndarray, bands: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(item, first diagonal, text) to align, of a text's bands. Neighbouring bands of an item
        are one; the text is what their diagonals cover, OUTSIDE where they leave it."""
        if not len(items):
            return
        new = np.flatnonzero(np.r_[True, (items[1:] != items[:-1]) | (bands[1:] != bands[:-1] + 1)])
        for item, low, high in zip(items[new].tolist(), bands[new].tolist(), np.r_[bands[new[1:] - 1], bands[-1:]].tolist()):
            k = int(self.budget[item])
            # An occurrence with k edits may leave the hits' diagonals by k more.
            low, high = low * (k + 1) - k, (high + 2) * (k + 1) + k
            size = high - low + len(self.codes[item])
            part = np.full(size, OUTSIDE, np.uint32)
            begin, end = max(low, 0), min(low + size, len(codes))
            part[begin - low:end - low] = codes[begin:end]
            yield item, low, part.tobytes()

    def align(self, todo: list[tuple[int, bytes]]) -> list[list[tuple[int, int, int]]]:
        """(edits, start, end) of the occurrences within the budget in each candidate's
        text, from that text's first place: the best one, and on among those that
        overlap none before.

        One banded table for many candidates: a row per character of the passages, a
        column per diagonal. A cell holds edits * UNIT + start, so minima carry the
        start along. Candidates whose whole row is over the budget leave early."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in todo]
        order = sorted(range(len(todo)), key=lambda t: (len(self.codes[todo[t][0]]), len(todo[t][1])))
        while order:
            size, group = 0, []
            while order and (not group or size * (len(group) + 1) <= CELLS):
                group.append(order.pop())
                size = max(size, len(todo[group[-1]][1]) // 4)
            self._align([(t, *todo[t]) for t in group], out)
        return out

    def _align(self, group: list[tuple[int, int, bytes]], out: list) -> None:
        who = np.array([t for t, _, _ in group])
        items = [i for _, i, _ in group]
        n = np.array([len(self.codes[i]) for i in items])
        limit = (self.budget[items] + 1) * UNIT
        wide = max(len(x) // 4 - len(self.codes[i]) + 1 for _, i, x in group)
        text = np.full((len(group), n.max() + wide), OUTSIDE, np.uint32)
        passage = np.zeros((len(group), n.max()), np.uint32)
        for r, (_, i, x) in enumerate(group):
            text[r, :len(x) // 4] = np.frombuffer(x, np.uint32)
            passage[r, :n[r]] = self.codes[i]
        inside = text != OUTSIDE
        # Places of the text: before each of its characters, and after the last.
        gone = ~np.c_[inside, np.zeros(len(group), bool)]
        gone[:, 1:] &= ~inside
        step = np.arange(wide) * UNIT
        cell = np.where(gone[:, :wide], FAR, np.arange(wide))
        for i in range(1, passage.shape[1] + 1):
            now = cell + (text[:, i - 1:i - 1 + wide] != passage[:, i - 1, None]) * UNIT
            np.minimum(now[:, :-1], cell[:, 1:] + UNIT, out=now[:, :-1])  # the passage's character is missing in the text
            now -= step
            np.minimum.accumulate(now, axis=1, out=now)  # characters added in the text
            now += step
            now[gone[:, i:i + wide]] = FAR
            cell = now
            ended = n == i
            if ended.any() or i % 8 == 0:
                least = cell.min(axis=1)
                for r in np.flatnonzero(ended & (least < limit)).tolist():
                    ends = np.flatnonzero(cell[r] < limit[r])
                    out[who[r]] = apart([(int(c // UNIT), int(c % UNIT), at + i) for at, c in zip(ends.tolist(), cell[r][ends].tolist())])
                stay = ~ended & (least < limit)
                if not stay.any():
                    return
                if ended.any() or 4 * stay.sum() < 3 * len(stay):
                    who, n, limit, text, passage, gone, cell = (x[stay] for x in (who, n, limit, text, passage, gone, cell))

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """search_all() of one text."""
        return next(self.search_all([text]))

    def search_all(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, int, int, int]]]:
        """For each text (item, edits, start, end): the occurrences of each passage that do
        not overlap, from its best one on. Equal candidates, as in copies, are aligned once while remembered."""
        waiting: list[list[tuple[int, int, bytes]]] = []
        held = 0
        for group in _groups(texts):
            codes, ends = _together(group), np.cumsum([len(t) for t in group])
            text, items, bands = self.bands_of_many(codes, ends) if len(codes) <= GROUP else (np.zeros(0), *self.bands(codes))
            edges = np.searchsorted(text, np.arange(len(group) + 1)) if len(codes) <= GROUP else np.array([0, len(items)])
            for t, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                waiting.append(list(self._candidates(codes[ends[t] - len(group[t]):ends[t]], items[a:b], bands[a:b])) if b > a else [])
                held += sum(len(x) for _, _, x in waiting[-1])
                if held >= 4 * CELLS or len(waiting) >= 4096:
                    yield from self._settle(waiting)
                    waiting, held = [], 0
        yield from self._settle(waiting)

    def _settle(self, waiting: list[list[tuple[int, int, bytes]]]) -> Iterator[list[tuple[int, int, int, int]]]:
        if self.memo_bytes > 8 * CELLS:
            self.memo.clear()
            self.memo_bytes = 0
        todo = list({(i, x): None for found in waiting for i, _, x in found if (i, x) not in self.memo})
        self.memo.update(zip(todo, self.align(todo)))
        self.memo_bytes += sum(len(x) for _, x in todo)
        for found in waiting:
            regions: dict[int, list[tuple[int, int, int]]] = {}
            for item, low, x in found:
                for edits, start, end in self.memo[item, x]:
                    regions.setdefault(item, []).append((edits, start + low, end + low))
            yield [(self.ids[i], *hit) for i in sorted(regions) for hit in apart(regions[i])]


def _blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    n = -(-2 * total // block_chars) if total > block_chars else 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _load(block: DataFrame, q: int, edits: float) -> Passages:
    return Passages(sorted((r[0] if r[0] is not None else -1, r[1]) for r in block.collect()), q, edits)


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, edits, start, end): each place of each document where a passage
    occurs with at most `edits` of its length changed; places of one passage are apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(block: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(_load(block, q, edits))  # at most block_chars characters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passages = shared.value
            for batch in batches:
                found = passages.search_all(t.as_py() for t in batch.column(1))
                out = [(d, *hit) for d, hits in zip(batch.column(0).to_pylist(), found) for hit in hits]
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "edits", "start", "end"])

        return rows.mapInArrow(run, "doc_id long, item_id long, edits long, start long, end long")

    return reduce(DataFrame.unionAll, [one(b) for b in _blocks(benchmark, block_chars)])


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of docs, all columns, that hold no passage; one pass per block."""
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index("text")
    for block in _blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(_load(block, q, edits))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            passages = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not hits for hits in passages.search_all(t.as_py() for t in batch.column(at))], pa.bool_()))
            give_back()

        docs = docs.mapInArrow(run, schema)
    return docs
