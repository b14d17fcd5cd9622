"""Removal of repeated strings by threshold-bounded interval expansion.

Every byte covered by a string of `length` bytes that also starts earlier goes.

1. Anchors. In each window of `length` bytes the leftmost smallest hash of its
   GRAM-byte substrings is the window's anchor, so equal windows have equal
   anchors at equal offsets. An anchor's context is the stretch covered by the
   windows that chose it. One row per anchor is dealt by its hash: no text. A
   context whose bytes stand earlier in the same batch is a repeat and is not dealt
   under its hash, so a passage that many documents share comes once a batch.
2. Groups. Anchors that occur once cannot be repeats. The contexts of the others
   fetch their bytes.
3. Intervals. Contexts of equal bytes are one class, and its first member stands
   for it. The classes of some anchors with several are joined into one string with
   separators. Its Burrows-Wheeler transform is extended backward breadth first: an interval
   of suffixes that share a prefix w yields the intervals of c+w for every byte c
   before them, and an interval's end that has no common prefix yet gets the length
   of w. Lengths are set by increasing value and expansion stops at `length`, so
   neighbours left unset share `length` bytes: runs of them are equal windows.
4. Spans. Repeated windows go back to their documents and are merged.

Bytes decide every repeat; hashes only say what meets. An anchor in more than
`chunk` contexts is split over tasks: its contexts are cut into single windows, each
dealt under a hash of its bytes, of equal ones in a batch the first only. They go
through the same transform.

Defined cases: null text is empty; texts under `length` bytes keep everything; a
null doc_id comes last; where doc_ids repeat, rows with equal texts too are one
document and lose the same bytes, others are ordered by a hash of their text; no
rows give no rows; other columns, of any name, are kept by clean().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import discard, materialize
from .memory import give_back, small_batches
from .simhash import groups_of

LENGTH, GRAM = 100, 32
#: Bytes of texts whose anchors are found at once.
SLICE = 1 << 18
_BASE = np.uint64(0xD1342543DE82EF95)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every `gram` bytes, by doubling: h(2k) = h(k) * B^k + h(k) shifted."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, have, parts, size = _BASE, _TABLE[data], None, 1
        done, total = 0, None
        while True:
            if gram & size:
                piece = have[done:done + n]
                total = piece.copy() if total is None else total * power + piece
                done += size
            size <<= 1
            if size > gram:
                break
            have = have[:len(have) - size // 2] * power + have[size // 2:]
            power = power * power
        total ^= total >> np.uint64(32)
        total *= _MIX
        total ^= total >> np.uint64(29)
    return total


def anchors(data: np.ndarray, length: int, gram: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all grams, anchor positions, first windows, last windows, texts) for texts
    that lie back to back and end at `ends`; places count from the first text's start."""
    h = window_hashes(data, gram)
    w, n = length - gram + 1, len(data) - length + 1
    if n <= 0:
        return h, *(np.zeros(0, np.int64),) * 4
    ends = np.array([len(data)]) if ends is None else ends
    # The leftmost minimum of w values, by doubling: a table of powers of two.
    best, at, size = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * size <= w:
        a, b = best[:-size], best[size:]
        right = b < a
        at = np.where(right, at[size:], at[:-size])
        best = np.where(right, b, a)
        size *= 2
    a, b = best[:n], best[w - size:w - size + n]
    choice = np.where(b < a, at[w - size:w - size + n], at[:n])
    # Windows inside one text; a run of one choice ends with its text.
    starts = np.r_[0, ends[:-1]]
    long = np.flatnonzero(ends - starts >= length)
    edges = np.zeros(n + 1, np.int8)
    edges[starts[long]] += 1
    edges[ends[long] - length + 1] -= 1
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(choice[1:], choice[:-1], out=new[1:])
    new[starts[long]] = True
    new = np.flatnonzero(new & (np.cumsum(edges[:-1], dtype=np.int8) > 0))
    text = np.searchsorted(ends, new, "right")
    last = np.minimum(np.r_[new[1:], n] - 1, ends[text] - length)
    return h, choice[new].astype(np.int64), new, last, text


def _kind(n: int) -> type:
    """The integers that hold places of a string of n symbols."""
    return np.int32 if n < 1 << 31 else np.int64


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `depth` symbols or more, and their ranks."""
    n, kind = len(text), _kind(len(text))
    width = max(1, int(text.max()).bit_length())
    per = min(62 // width, depth)
    key = np.zeros(n, np.int64)
    for k in range(per):
        key <<= width
        if k < n:
            key[:n - k] |= text[k:]
    size = per
    while True:
        order = np.argsort(key).astype(kind)  # suffixes that agree so far come in any order
        key = key[order]
        rank = np.empty(n, kind)
        rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]], dtype=kind)
        if size >= depth or rank[order[-1]] == n - 1:
            return order, rank
        key = rank.astype(np.int64)
        key *= n + 1
        if size < n:
            key[:n - size] += rank[size:]
            key[:n - size] += 1
        size *= 2


def bounded_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, up to `limit`; suffixes
    that agree up to and with a separator (0) count as `limit`.

    Breadth-first backward extension over the transform: intervals [lo, hi) of
    suffixes that begin with w, all of one length per level. Occurrence ranks
    come from a stable sort of the transform (LF mapping), so c+w is found by
    mapping the first and last c of an interval."""
    n, kind = len(text), _kind(len(text))
    bwt = text[order - 1]
    lf = np.empty(n, kind)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=kind)
    prefix = np.full(n + 1, limit, np.int32)
    prefix[0] = 0
    known = np.zeros(n + 1, bool)
    known[0] = True
    lo, hi = np.zeros(1, kind), np.full(1, n, kind)
    for size in range(limit):
        if not len(lo):
            break
        # Extend every interval by each symbol before it.
        spans = hi - lo
        owner = np.repeat(np.arange(len(lo), dtype=kind), spans)
        inside = np.arange(spans.sum(), dtype=kind)
        inside += np.repeat(lo - (np.cumsum(spans, dtype=kind) - spans), spans)
        symbol, to = bwt[inside], lf[inside]
        del inside
        if size:  # a prefix may end in a separator but never holds one inside
            real = symbol > 0
            symbol, to, owner = symbol[real], to[real], owner[real]
        if not len(to):
            break
        near = np.argsort(symbol, kind="stable")  # places of one symbol rise with the intervals: one of one interval maps to neighbours
        to, own, sym = to[near], owner[near], symbol[near]
        del near, owner, symbol
        new = np.flatnonzero(np.r_[True, (to[1:] != to[:-1] + 1) | (own[1:] != own[:-1]) | (sym[1:] != sym[:-1])])
        first = to[new]
        last = np.r_[to[new[1:] - 1], to[-1]] + 1
        fresh = ~known[last]
        prefix[last[fresh]] = size
        known[last[fresh]] = True
        lo, hi = first[fresh], last[fresh]
    return np.where(known[:n], prefix[:n], limit)


def repeats(contexts: list[bytes], starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of class contexts by equal text: (class, offset, run), where run
    numbers windows with the same `length` bytes. starts and counts say which
    offsets of each class are its windows."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    used = np.zeros(256, bool)
    used[raw] = True
    sep = np.arange(len(contexts)) + np.cumsum(sizes)
    text = np.zeros(len(raw) + len(contexts), np.uint16)  # 0 ends every context
    begin = np.cumsum(sizes + 1) - sizes - 1
    body = np.ones(len(text), bool)
    body[sep] = False
    text[body] = np.cumsum(used, dtype=np.uint16)[raw]
    del body
    order, _ = suffix_array(text, length)
    prefix = bounded_prefixes(text, order, length)
    cls = np.repeat(np.arange(len(contexts)), counts)
    off = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    place = np.empty(len(text), order.dtype)
    place[order] = np.cumsum(prefix < length, dtype=order.dtype)
    del order, prefix
    return cls, off, place[begin[cls] + off]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, text), and the same with each uid once: uid orders documents;
    it is doc_id itself where that is unique."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    twice = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null or doc_id = 9223372036854775807")
    if twice.isEmpty():
        rows = rows.select(F.col("doc_id").alias("uid"), "doc_id", "text")
        return rows, rows
    from ..operators.ordinal import with_ordinal

    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    marked = materialize(rows.withColumn("_key", key), "documents")
    names = with_ordinal(marked.select("_key").distinct(), "_key", name="uid")
    rows = materialize(marked.join(names, "_key").select("uid", "doc_id", "text"), "documents")
    return rows, materialize(rows.dropDuplicates(["uid"]), "documents")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `size` of them, one range after the other."""
    upto = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)


def _late(data: np.ndarray, key: np.ndarray, uid: np.ndarray, a: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which stretches data[at:at + size] have the bytes of one with the same key that
    starts earlier, by (uid, a); stretches with one key and other bytes are not."""
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    late = np.zeros(len(key), bool)
    if not len(same):
        return late
    mine = np.zeros(len(key), bool)
    mine[same] = mine[same + 1] = True
    some = order[mine]
    some = some[np.lexsort((a[some], uid[some], key[some]))]
    new = np.r_[True, key[some][1:] != key[some][:-1]]
    first = some[np.flatnonzero(new)[np.cumsum(new) - 1]]
    rest = np.flatnonzero(~new & (size[some] == size[first]))
    raw = data.tobytes()
    equal = [raw[i:i + n] == raw[j:j + n] for i, j, n in zip(at[some[rest]].tolist(), at[first[rest]].tolist(), size[some[rest]].tolist())]
    late[some[rest[np.array(equal, bool)]]] = True
    return late


def _spread(uid: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A key that deals rows evenly."""
    with np.errstate(over="ignore"):
        return ((uid + a).astype(np.uint64) * _MIX).view(np.int64)


_ANCHOR = ["h", "uid", "a", "b", "late"]


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, uid, a, b, late): anchor hash, first and last window. Rows whose context's bytes
    stand earlier in the batch are marked late and dealt evenly."""

    def some(uids: list[int], raws: list[bytes]) -> tuple[np.ndarray, ...]:
        """Columns of the anchors of some texts, and their places in them back to back."""
        ends = np.cumsum([len(r) for r in raws])
        h, pos, a, b, text = anchors(np.frombuffer(b"".join(raws), np.uint8), length, gram, ends)
        with np.errstate(over="ignore"):  # the grams at both ends, the anchor and its place
            key = h[a] * _BASE + h[b + length - gram] * _MIX + h[pos] + (pos - a).astype(np.uint64)
        start = (ends - [len(r) for r in raws])[text]
        return h[pos].view(np.int64), np.array(uids, np.int64)[text], (a - start).astype(np.int32), (b - start).astype(np.int32), key, a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            texts: list[bytes] = []
            uids: list[int] = []
            begin = done = size = 0  # bytes of the slices before; texts in them; bytes waiting
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = _bytes(text.as_py())
                if len(raw) >= length:
                    texts.append(raw)
                    uids.append(uid)
                    size += len(raw)
                if size >= SLICE:
                    *cols, at = some(uids[done:], texts[done:])
                    out.append((*cols, at + begin))
                    begin, done, size = begin + size, len(texts), 0
            if size:
                *cols, at = some(uids[done:], texts[done:])
                out.append((*cols, at + begin))
            if not texts:
                continue
            h, uid, a, b, key, at = (np.concatenate(o) for o in zip(*out))
            late = _late(np.frombuffer(b"".join(texts), np.uint8), key, uid, a, at, b - a + length)
            h[late] = _spread(uid[late], a[late])
            del out, texts, key, at
            for k in range(0, len(late), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k:k + (1 << 16)]) for x in (h, uid, a, b, late)], _ANCHOR)
        give_back()

    return docs.select("uid", "text").mapInArrow(run, "h long, uid long, a int, b int, late boolean")


#: What becomes of an anchor's row: settled as a repeat, to be compared, to be compared window by window.
SETTLED, MEETS, CROWDED = range(3)


def _groups(rows: DataFrame, chunk: int) -> DataFrame:
    """(h, uid, a, b, fate) from rows sorted by h: late rows, and those of anchors that
    occur again. At most `chunk` rows of one anchor are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # of the last anchor, which may go on
        name, many = None, False

        def put(cols: list[np.ndarray], fate: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(fate):
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(fate.astype(np.int32))], ["h", "uid", "a", "b", "fate"])

        def close() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*held)] if held else [np.zeros(0, np.int64)] * 4
            if len(cols[0]) > 1 or many:
                yield from put(cols, np.full(len(cols[0]), CROWDED if many else MEETS))

        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(4)]
            late = batch.column(4).to_numpy(zero_copy_only=False)
            if late.any():
                yield from put([c[late] for c in cols], np.full(late.sum(), SETTLED))
                cols = [c[~late] for c in cols]
            h = cols[0]
            if not len(h):
                continue
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[new, len(h)])
            if name is not None and h[0] == name:
                held.append([c[:size[0]] for c in cols])
            if name is None or h[0] != name or len(new) > 1:
                yield from close()
                held, many = [], False
            if sum(len(x[0]) for x in held) > chunk:  # crowded: nothing is held any more
                many = True
                yield from close()
                held = []
            # Whole groups of this batch; the last one may go on, the first has been added to what is held.
            begin = int(name is not None and h[0] == name)
            whole = np.repeat(size, size)
            inner = np.zeros(len(h), bool)
            if len(new) > 1:
                inner[new[begin] if begin < len(new) else len(h):new[-1]] = True
            inner &= whole > 1
            yield from put([c[inner] for c in cols], np.where(whole[inner] > chunk, CROWDED, MEETS))
            if len(new) > 1 or not begin:
                held, name = [[c[new[-1]:] for c in cols]], h[-1]
                if size[-1] > chunk:
                    many = True
                    yield from close()
                    held = []
        yield from close()

    return rows.mapInArrow(run, "h long, uid long, a int, b int, fate int")


def _contexts(found: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(h, uid, a, b, text): the bytes of the contexts that meet others; single windows, by
    a hash of theirs, of crowded anchors. Windows that stand earlier in the batch are
    settled: they have no text."""
    asked = found.where(F.col("fate") != SETTLED).groupBy("uid").agg(F.collect_list(F.struct("h", "a", "b", "fate")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in range(0, len(whole), 1024):
                batch = whole.slice(cut, 1024)
                raws = [_bytes(t.as_py()) for t in batch.column(1)]
                lists = batch.column(2)
                counts = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                h, a, b, fate = (flat.field(k).to_numpy() for k in range(4))
                data = np.frombuffer(b"".join(raws), np.uint8)
                sizes = np.fromiter(map(len, raws), np.int64, len(raws))
                base = np.repeat(np.cumsum(sizes) - sizes, counts)
                uid = np.repeat(batch.column(0).to_numpy(), counts)
                good = fate == MEETS
                for k in np.array_split(np.flatnonzero(good), max(1, int((b - a + length)[good].sum() >> 22))):
                    yield from _cut_out(data, h[k], uid[k], a[k], b[k], base[k] + a[k], (b - a)[k] + length)
                for k in np.array_split(np.flatnonzero(~good), max(1, int((~good).sum() >> 13))):
                    n = (b - a)[k].astype(np.int64) + 1
                    pos = _ranges(a[k].astype(np.int64), n)
                    at, of = np.repeat(base[k], n) + pos, np.repeat(uid[k], n)
                    key = np.fromiter((xxhash.xxh64_intdigest(data[i:i + length]) for i in at.tolist()), np.uint64, len(at))
                    late = _late(data, key, of, pos, at, np.full(len(at), length))
                    again = np.flatnonzero(late)
                    if len(again):
                        yield _context_batch(_spread(of[again], pos[again]), of[again], pos[again], pos[again], pa.nulls(len(again), pa.binary()))
                    some = np.flatnonzero(~late)
                    yield from _cut_out(data, key[some].view(np.int64), of[some], pos[some], pos[some], at[some], np.full(len(some), length))
        give_back()

    return docs.select("uid", "text").join(asked, "uid").mapInArrow(run, "h long, uid long, a int, b int, text binary")


def _cut_out(data: np.ndarray, h: np.ndarray, uid: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(h):
        size = size.astype(np.int64)
        offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
        text = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets), pa.py_buffer(data[_ranges(at, size)])])
        yield _context_batch(h, uid, a, b, text)


def _context_batch(h: np.ndarray, uid: np.ndarray, a: np.ndarray, b: np.ndarray, text: pa.Array) -> pa.RecordBatch:
    cols = [pa.array(h), pa.array(uid, pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), text]
    return pa.RecordBatch.from_arrays(cols, ["h", "uid", "a", "b", "text"])


def _expand(contexts: DataFrame, length: int) -> DataFrame:
    """(uid, a, b): stretches of windows whose bytes stand earlier, from classes and transforms."""
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = contexts.repartition(parts, "h").sortWithinPartitions("h")

    def span(uid: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["uid", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["h"], most=4096):
            table = table.combine_chunks()
            h, uid, a, b = (table[k].to_numpy().astype(np.int64) for k in ("h", "uid", "a", "b"))
            text = table["text"].combine_chunks()
            if text.null_count:
                done = text.is_null().to_numpy(zero_copy_only=False)
                yield span(uid[done], a[done], b[done])
                h, uid, a, b, text = h[~done], uid[~done], a[~done], b[~done], text.filter(pa.array(~done))
            if not len(uid):
                continue
            coded = text.dictionary_encode()  # by bytes
            cls = coded.indices.to_numpy()
            order = np.lexsort((a, uid, cls))
            first = np.r_[True, cls[order][1:] != cls[order][:-1]]
            copies, some = order[~first], order[first]  # some: the first member of every class, in order of class
            if len(copies):
                yield span(uid[copies], a[copies], b[copies])
            # Windows of one context differ, as their anchor stands at different offsets: a lone class holds no other repeats.
            anchor = h[some]
            _, at, times = np.unique(anchor, return_inverse=True, return_counts=True)
            several = times[at] > 1
            if not several.any():
                continue
            uid, a, b = (x[some][several] for x in (uid, a, b))
            of, off, place = repeats(coded.dictionary.filter(pa.array(several)).to_pylist(), np.zeros(len(a), np.int64), b - a + 1, length)
            pos = a[of] + off
            order = np.lexsort((pos, uid[of], place))
            again = np.r_[False, place[order][1:] == place[order][:-1]]
            mine = np.sort(order[again])  # in order of class and offset
            if not len(mine):
                continue
            c, x = of[mine], pos[mine]
            new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (x[1:] != x[:-1] + 1)])
            end = np.r_[new[1:], len(mine)] - 1
            yield span(uid[c[new]], x[new], x[end])
        give_back()

    return rows.mapInArrow(run, "uid long, a int, b int")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = 500) -> DataFrame:
    """(uid, a, b) for docs(uid, text): first and last window of stretches whose
    windows all start earlier somewhere; stretches may overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = anchor_rows(docs, length, gram).repartition(parts, "h").sortWithinPartitions("h")
    found = materialize(_groups(rows, chunk), "groups")
    settled = found.where(F.col("fate") == SETTLED).select("uid", "a", "b")
    spans = materialize(settled.unionAll(_expand(_contexts(found, docs, length), length)), "spans")
    discard(found)
    return spans


def merged(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) from window stretches."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        end = b + length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((a, end))
    return out


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2]))


def _with_spans(docs: DataFrame, length: int, gram: int, chunk: int) -> DataFrame:
    """(uid, doc_id, text, windows) per document of docs(doc_id, text)."""
    rows, single = _numbered(docs)
    spans = repeated(single, length, gram, chunk).groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("windows"))
    return rows.join(spans, "uid", "left")


def _pairs(cell: pa.Scalar) -> list[tuple[int, int]]:
    return [(x["a"], x["b"]) for x in cell.as_py() or []]


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = 500) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, windows in zip(batch.column(1), batch.column(2)):
                raw = _bytes(text.as_py())
                spans = merged(_pairs(windows), length)
                out.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_cut(raw, spans)).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(x), k) for x, k in zip(cols, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return _with_spans(docs, length, gram, chunk).select("doc_id", "text", "windows").mapInArrow(run, kind)


def clean(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = 500) -> DataFrame:
    """docs with its columns, repeats cut out of text; a character that loses a byte
    goes whole. n_chars, where there is one, counts what is left. Rows travel as one
    struct, so their columns may have any names."""

    @F.pandas_udf("string")
    def cut(text, windows):
        def one(t, w):
            raw = _bytes(t)
            return _cut(raw, merged([(x["a"], x["b"]) for x in w], length)).decode("utf-8", "ignore")

        return text.combine(windows, one)

    def named(doc_id, text):
        return [doc_id.cast("long").alias("doc"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("hash")]

    found = _with_spans(docs, length, gram, chunk).where("windows is not null")
    new = found.select(*named(F.col("doc_id"), F.col("text")), cut("text", "windows").alias("cut")).dropDuplicates(["doc", "hash"])
    rows = docs.select(F.struct("*").alias("row"), *named(F.col("doc_id"), F.col("text"))).alias("r")
    met = rows.join(new.alias("n"), F.col("r.doc").eqNullSafe(F.col("n.doc")) & (F.col("r.hash") == F.col("n.hash")), "left")
    row, text = F.col("r.row"), F.col("n.cut")
    changed = {"text": F.coalesce(text, row["text"])}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(text.isNotNull(), F.length(text).cast(kind)).otherwise(row["n_chars"])
    return met.select(*[changed.get(c, row[c]).alias(c) for c in docs.columns])
