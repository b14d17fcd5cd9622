"""SimHash near-duplicate groups by pigeonhole blocks.

A fingerprint is the bitwise majority over the XXH64 values of a text's word
shingles. It is cut into `blocks` pieces; two fingerprints that differ in at
most `distance` bits agree on at least `blocks - distance` pieces, so every
close pair shares one of the keys made of that many pieces. Equal fingerprints
are one class before anything is joined. Keys held by one class only are
dropped; a key held by many is dealt over pairs of chunks, so no task sees more
than two chunks. A task sends on a spanning forest of the links it verified,
never all pairs, and components() joins the forests.

similar_texts() uses the same blocks for near copies by similarity. Texts whose shingle
sets have a Jaccard similarity of 4/5 differ in some 10 of 64 bits, and no choice of
blocks both meets all those pairs and keeps keys rare. So several fingerprints are
taken of each set: `tables` of them give keys, each of any `agree` of its pieces, and
all together, as one longer fingerprint, give the distance within which a link is tried.
Links of a group go on as a spanning forest of least distances, and the similarity of
every link that goes on is worked out on the whole sets. This joins most of each group
of near copies, but not all: blocks meet such pairs with a probability only.

A second search then meets every pair that is left. Two sets of that similarity share
one of their first hashes in any one order, n - ceil(p n / q) + 1 of a set of n
(rest_links). Common hashes come last in that order; shared hashes inside one component
have nothing left to join and go before anything is paired; of what is left, sizes, places
in the order and parities of the sets bound the similarity from above, and the whole
sets decide. Both searches together find every link that joins anything.

Defined cases: null text is empty; no words give fingerprint zero, linked like
any other; equal rows share a class; a null doc_id is kept but is never a
component's name unless the class has no other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import discard, materialize
from .components import components
from .memory import give_back, small_batches

_BLOCK = 1 << 15  # shingles hashed at a time
_COUNTED, _SPREAD = 1 << 22, 1 << 19  # hashes counted, keys sent at a time
_ROW = np.dtype([("key", "<u4"), ("at", "<u4"), ("n", "<u4"), ("class", "<i8"), ("component", "<i8")])
#: Rows of 20 bytes that are broadcast at most.
MOST_HOT = 500_000


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit majority of the shingles' hashes, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    stops = ends[words - 1:] if len(parts) >= words else ends[-1:]
    votes, xx = np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, n, _BLOCK):
        a, b = starts[k:min(n, k + _BLOCK)].tolist(), stops[k:k + _BLOCK].tolist()
        raw = b"".join(map(xx, [joined[i:j] for i, j in zip(a, b)], repeat(seed)))
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _cuts(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each piece of the 64 bits."""
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def keyed(classes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(key, node, fp): one row per class and choice of agreeing pieces."""
    cuts = _cuts(blocks)
    keys = []
    for i, chosen in enumerate(combinations(cuts, blocks - distance)):
        mask = sum(((1 << w) - 1) << s for s, w in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed)).alias("v")))
    return classes.select(F.explode(F.array(*keys)).alias("key"), "node", "fp")


def dealt(rows: DataFrame, key: str, ident: str, chunk: int) -> DataFrame:
    """Rows of keys that at least two share, with the pair task (i, j) each goes
    to. A key with more than `chunk` rows is cut into chunks by hash of `ident`,
    and each row goes to the tasks of its chunk with every chunk."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    met = rows.join(counts, key).withColumn("_m", F.ceil(F.col("_n") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64(ident), F.col("_m")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda j: F.struct(F.least(j, F.col("_c")).alias("i"), F.greatest(j, F.col("_c")).alias("j")))
    return met.withColumn("_c", mine).withColumn("_t", F.explode(tasks)).select("*", "_t.i", "_t.j").drop("_n", "_m", "_c", "_t")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _links(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group within the distance; `group` is sorted."""
    left, right = [], []
    for lag in range(1, len(group)):
        same = np.flatnonzero(group[lag:] == group[:-lag])
        if not len(same):
            break
        close = same[np.bitwise_count(fp[same + lag] ^ fp[same]) <= distance]
        left.append(close)
        right.append(close + lag)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables that end where a group ends, from batches sorted by `keys`."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> int:
        """Rows before the last group."""
        n, start = len(table), 0
        for k in keys:
            col = table[k].combine_chunks().to_numpy(zero_copy_only=False)
            other = np.flatnonzero(col != col[-1])
            start = max(start, int(other[-1]) + 1 if len(other) else 0)
        return min(start, n)

    for batch in batches:
        held.append(batch)
        if sum(len(x) for x in held) >= most:
            table = pa.Table.from_batches(held)
            if at := cut(table):
                yield table.slice(0, at)
                held = table.slice(at).to_batches()
    if held and sum(len(x) for x in held):
        yield pa.Table.from_batches(held)


def group_ids(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Number of each row's group in a table sorted by `keys`."""
    new = np.zeros(len(table), bool)
    for k in keys:
        col = table[k].to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.cumsum(new)


def links(classes: DataFrame, distance: int = 4, blocks: int = 6, chunk: int = 1000) -> DataFrame:
    """(a, b): a spanning forest of the close pairs of each key."""
    rows = keyed(classes, distance, blocks)
    rows = dealt(rows, "key", "fp", chunk).select("key.t", "key.v", "i", "j", "node", "fp")
    keys = ["t", "v", "i", "j"]
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, keys):
            fp = table["fp"].to_numpy().view(np.uint64)
            a, b = _links(group_ids(table, keys), fp, distance)
            label = forest(len(fp), a, b)
            node = table["node"].to_numpy()
            at = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def blocks_for(classes: int, distance: int) -> int:
    """The fewest pieces, two more than the distance at least, whose keys have a bit more
    than it takes to tell the classes apart: then a key meets few classes by chance, and
    candidates grow with the table and not with its square. Any number finds the same pairs."""
    blocks = min(64, distance + 2)
    while blocks < 64 and sum(sorted(w for _, w in _cuts(blocks))[:blocks - distance]) <= classes.bit_length():
        blocks += 1
    return blocks


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, blocks: int | None = None, seed: int = 42, chunk: int = 1000) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text)."""
    if not 0 <= distance < (blocks or 64) <= 64:
        raise ValueError("blocks must exceed distance")
    small_batches(docs.sparkSession)
    marked = materialize(fingerprints(docs, words, seed), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    found = components(links(classes.where("node is not null"), distance, blocks or blocks_for(classes.count(), distance), chunk))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "fp")


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The set of the shingles' hashes, ascending; A-Z are lower-cased, a text shorter
    than a shingle is one."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    stops = ends[words - 1:] if len(parts) >= words else ends[-1:]
    found = []
    for k in range(0, len(stops), _BLOCK):
        a, b = starts[k:min(len(stops), k + _BLOCK)].tolist(), stops[k:k + _BLOCK].tolist()
        raw = b"".join(map(xxhash.xxh64_digest, [joined[i:j] for i, j in zip(a, b)], repeat(seed)))
        found.append(np.frombuffer(raw, ">u8").astype(np.uint64))
    return np.unique(np.concatenate(found))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes of the k-th fingerprint: as they are, then well mixed again."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def set_fingerprints(found: np.ndarray, lengths: int) -> list[int]:
    """`lengths` fingerprints of 64 bits, as signed longs, of a set of hashes."""
    out = []
    for k in range(lengths):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(found), _BLOCK):
            bits = np.unpackbits(_mixed(found[at:at + _BLOCK], k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes += bits.sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * votes > len(found)).tobytes(), "big", signed=True))
    return out


def parity(s: np.ndarray) -> np.ndarray:
    """Bits that say on which of a power of two of places, two a hash at least, an odd
    number of hashes falls; two sets differ in no fewer hashes than their parities in bits."""
    m = 1 << max(6, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray) -> np.ndarray:
    """Parities (the last axis) on half as many places."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _name(s: np.ndarray, seed: int) -> int:
    """The class of a set of hashes, as a signed long."""
    return int.from_bytes(xxhash.xxh64_digest(s.tobytes(), seed), "big", signed=True)


def described(docs: DataFrame, words: int, lengths: int, seed: int) -> DataFrame:
    """(doc_id, class, n, fps, part): the class names the shingle set, n is its size,
    part its parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, prints, parts = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words, seed)
                names.append(_name(s, seed))
                sizes.append(len(s))
                prints.append(set_fingerprints(s, lengths))
                parts.append(parity(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(parts, pa.binary())],
                ["doc_id", "class", "n", "fps", "part"],
            )
        give_back()

    return _texts(docs).mapInArrow(run, "doc_id long, class long, n long, fps array<long>, part binary")


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) among n nodes make a spanning forest of least weight:
    in each round every component takes its lightest link to another one."""
    order = np.argsort(weight, kind="stable")
    a, b = a[order], b[order]
    label, taken, left = np.arange(n), [], np.arange(len(a))
    while len(left):
        x, y = label[a[left]], label[b[left]]
        out = x != y
        left, x, y = left[out], x[out], y[out]
        if not len(left):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        new = np.unique(best[best < len(a)])
        taken.append(new)
        label = forest(n, np.r_[a[np.concatenate(taken)], np.arange(n)], np.r_[b[np.concatenate(taken)], label])
    return order[np.concatenate(taken)] if taken else np.zeros(0, np.int64)


def _similar_links(classes: DataFrame, least: tuple[int, int], lengths: int, tables: int, blocks: int, agree: int, distance: int, chunk: int) -> DataFrame:
    """(a, b): of each key's pairs within the distance, and of sizes that can reach the
    similarity, a spanning forest of least distances."""
    keys = []
    for t in range(tables):
        for c, chosen in enumerate(combinations(_cuts(blocks), agree)):
            mask = sum(((1 << w) - 1) << s for s, w in chosen)
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.struct(F.lit(t << 16 | c).alias("t"), F.col("fps")[t].bitwiseAND(F.lit(signed)).alias("v")))
    rows = classes.select(F.explode(F.array(*keys)).alias("key"), "node", F.col("n").cast("int").alias("n"), *[F.col("fps")[k].alias(f"f{k}") for k in range(lengths)])
    rows = rows.select("key.t", "key.v", "node", "n", *[f"f{k}" for k in range(lengths)])
    # Keys of many classes are cut into chunks and each pair of chunks is a task's group.
    hot = rows.groupBy("t", "v").agg(F.count("*").alias("c")).where(F.col("c") > chunk).select("t", "v", F.ceil(F.col("c") / chunk).cast("int").alias("m"))
    hot = materialize(hot, "hot")
    small = F.broadcast(hot) if hot.count() <= MOST_HOT else hot
    rows = rows.join(small, ["t", "v"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least(j, F.col("chunk")).alias("i"), F.greatest(j, F.col("chunk")).alias("j")))
    rows = rows.withColumn("task", F.explode(tasks))
    group = ["t", "v", "i", "j"]
    rows = rows.select("t", "v", "task.i", "task.j", "chunk", "node", "n", *[f"f{k}" for k in range(lengths)])
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *group).sortWithinPartitions(*group)
    p, q = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, group):
            ids, across = group_ids(table, group), table["i"].to_numpy() != table["j"].to_numpy()
            node, n, part = table["node"].to_numpy(), table["n"].to_numpy().astype(np.int64), table["chunk"].to_numpy()
            prints = [table[f"f{k}"].to_numpy().view(np.uint64) for k in range(lengths)]
            left, right, apart = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lag in range(1, len(ids)):
                x = np.flatnonzero(ids[lag:] == ids[:-lag])
                if not len(x):
                    break
                y = x + lag
                far = reduce(np.add, [np.bitwise_count(f[x] ^ f[y]).astype(np.int64) for f in prints])
                good = (far <= distance) & (q * np.minimum(n[x], n[y]) >= p * np.maximum(n[x], n[y])) & (~across[x] | (part[x] != part[y]))
                left.append(x[good])
                right.append(y[good])
                apart.append(far[good])
            a, b = np.concatenate(left), np.concatenate(right)
            some = spanning(len(ids), a, b, np.concatenate(apart))
            x, y = node[a[some]], node[b[some]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
        give_back()

    return rows.mapInArrow(run, "a long, b long").distinct()


def bounded(pairs: DataFrame, classes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs whose parities leave room for the similarity."""
    p, q = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for m, n, x, y in zip(*(c.to_pylist() for c in batch.columns[2:])):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                while len(x) != len(y):
                    x, y = (folded(x), y) if len(x) > len(y) else (x, folded(y))
                good.append(np.bitwise_count(x ^ y).sum(dtype=np.int64) <= m + n - 2 * -(-p * (m + n) // (p + q)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def side(name: str, n: str, part: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("n").alias(n), F.col("part").alias(part))

    met = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    return met.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, words: int, least: tuple[int, int], seed: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    p, q = least

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words, seed).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "s"])
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append((p + q) * both >= p * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        give_back()

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = materialize(_texts(docs).join(ids, "doc_id", "left_semi").mapInArrow(sets, "id long, s binary").dropDuplicates(["id", "s"]), "sets")
    met = pairs.join(held.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def common(texts: DataFrame, words: int, seed: int, least: int) -> np.ndarray:
    """Hashes that stand often in some block of sets, and together in `least` sets or more.
    The order of hashes follows from them; any order finds the same pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found[times > 2].view(np.int64)), pa.array(times[times > 2])], ["h", "c"])

        held, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                held.append(shingles(text.as_py(), words, seed))
                size += len(held[-1])
                if size >= _COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()
        give_back()

    often = texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("h")
    return np.sort(often.toArrow()["h"].to_numpy().view(np.uint64))


def _first(s: np.ndarray, often: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """The hashes of which two sets of the similarity share one: by value, common ones last."""
    p, q = least
    if len(often):
        late = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
        s = np.concatenate([s[~late], s[late]])
    return s[:len(s) - -(-p * len(s) // q) + 1]


def _possible(m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether sets of m and n hashes that share their i-th and j-th can reach the similarity."""
    p, q = least
    return (p + q) * (np.minimum(i, j) + 1 + np.minimum(m - i, n - j) - 1) >= p * (m + n)


def _lags(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs inside the groups of a sorted array, by lag."""
    if not len(group):
        return
    last = np.flatnonzero(np.r_[group[1:] != group[:-1], True])
    end = np.repeat(last, np.diff(last, prepend=-1))
    x, lag = np.arange(len(group)), 1
    while len(x := x[x + lag <= end[x]]):
        yield x, x + lag
        lag += 1


def shared(texts: DataFrame, often: np.ndarray, words: int, least: tuple[int, int], seed: int, chunk: int) -> DataFrame:
    """(key, at, class, component): of the first hashes of each set, those shared with a set
    of another component that can be similar. Keys travel in arrays, one for each bucket."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * parts

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt_out() -> pa.RecordBatch:
            rows, bucket = np.concatenate(held), np.concatenate(where)
            order = np.argsort(bucket, kind="stable")
            found, starts = np.unique(bucket[order], return_index=True)
            cut = np.split(rows[order], starts[1:])
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], ["bucket", "rows"])

        held, where, size = [], [], 0
        for batch in batches:
            for text, component in zip(batch.column("text"), batch.column("component")):
                s = shingles(text.as_py(), words, seed)
                mixed = _mixed(_first(s, often, least), 1)
                rows = np.empty(len(mixed), _ROW)
                rows["key"], rows["at"], rows["n"] = mixed >> np.uint64(32), np.arange(len(mixed)), len(s)
                rows["class"], rows["component"] = _name(s, seed), component.as_py()
                held.append(rows)
                where.append(((mixed & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32))
                size += len(rows)
                if size >= _SPREAD:
                    yield dealt_out()
                    held, where, size = [], [], 0
        if size:
            yield dealt_out()
        give_back()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["bucket"], 1):
            packed = table["rows"].to_pylist()
            rows = np.frombuffer(b"".join(packed), _ROW)
            bucket = np.repeat(table["bucket"].to_numpy().astype(np.int64), [len(x) // _ROW.itemsize for x in packed])
            key = bucket << 32 | rows["key"]
            order = np.lexsort((rows["component"], rows["class"], key))
            rows, key = rows[order], key[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (rows["class"][1:] != rows["class"][:-1]) | (rows["component"][1:] != rows["component"][:-1])]
            rows, key = rows[new], key[new]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(first, append=len(key))
            several = np.minimum.reduceat(rows["component"], first) < np.maximum.reduceat(rows["component"], first)
            inside = np.repeat(several, sizes)
            rows, key, sizes = rows[inside], key[inside], np.repeat(sizes, sizes)[inside]
            good = sizes > chunk  # of crowded keys all rows go on, to be dealt over tasks
            few = np.flatnonzero(~good)
            n, at, component, name = (rows[c][few].astype(np.int64) for c in ("n", "at", "component", "class"))
            for x, y in _lags(key[few]):
                some = (component[x] != component[y]) & (name[x] != name[y]) & _possible(n[x], n[y], at[x], at[y], least)
                good[few[x[some]]] = True
                good[few[y[some]]] = True
            rows, key = rows[good], key[good]
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(rows[c].astype(np.int64)) for c in ("at", "class", "component"))], ["key", "at", "class", "component"])
        give_back()

    sent = texts.mapInArrow(spread, "bucket int, rows binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(met, "key long, at long, class long, component long")


class _Parities:
    """Parities of many sets, by their number of places."""

    def __init__(self, parts: list[bytes]):
        self.width = np.array([len(x) for x in parts], np.int64)
        self.at, self.bits = np.zeros(len(parts), np.int64), {}
        for w in np.unique(self.width).tolist():
            mine = np.flatnonzero(self.width == w)
            self.at[mine] = np.arange(len(mine))
            self.bits[w] = np.frombuffer(b"".join(parts[i] for i in mine.tolist()), np.uint8).reshape(len(mine), w)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the parities of x[i] and y[i] differ, of sets of similar sizes."""
        out = np.zeros(len(x), np.int64)
        wx, wy = self.width[x], self.width[y]
        for w in np.unique(np.minimum(wx, wy)).tolist():
            mine = np.flatnonzero(np.minimum(wx, wy) == w)
            for k in range(0, len(mine), step := max(1, (1 << 23) // w)):
                some = mine[k:k + step]
                out[some] = np.bitwise_count(self._rows(x[some], w) ^ self._rows(y[some], w)).sum(axis=1, dtype=np.int64)
        return out

    def _rows(self, x: np.ndarray, w: int) -> np.ndarray:
        """Parities on w bytes."""
        out, widths = np.empty((len(x), w), np.uint8), self.width[x]
        for v in np.unique(widths).tolist():
            bits = self.bits[v][self.at[x[widths == v]]]
            while bits.shape[1] > w:
                bits = folded(bits)
            out[widths == v] = bits
        return out.view(np.uint64)


def rest_links(docs: DataFrame, marked: DataFrame, classes: DataFrame, found: DataFrame, words: int, least: tuple[int, int], seed: int, chunk: int) -> DataFrame:
    """(a, b): every pair of nodes of different components in `found` that may reach the
    similarity: none that does is missing."""
    p, q = least
    # One text of each class will do, and its component where it isn't its own.
    rows = marked.where("doc_id is not null").join(classes.select("class", "node"), "class")
    copies = rows.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("node")).alias("copy")).where("copy")
    marks = copies.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "full")
    marks = materialize(marks, "marks")
    small = F.broadcast(marks) if marks.count() <= MOST_HOT else marks
    texts = _texts(docs).where("doc_id is not null").join(small, "doc_id", "left").where("copy is null").select("text", F.coalesce("component", "doc_id").alias("component"))
    often = common(texts, words, seed, max(16, classes.count() >> 11))
    near = materialize(shared(texts, often, words, least, seed, chunk), "near")
    group = ["key", "i", "j"]
    rows = dealt(near, "key", "class", chunk).join(classes.select("class", "node", "n", "part"), "class")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(*group, "at", "component", "node", "n", "part").repartition(parts, *group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, group, 1 << 12):
            at, component, node, n = (table[c].to_numpy() for c in ("at", "component", "node", "n"))
            held, pairs = _Parities(table["part"].to_pylist()), [np.zeros((0, 2), np.int64)]
            for x, y in _lags(group_ids(table, group)):
                some = (component[x] != component[y]) & (node[x] != node[y]) & _possible(n[x], n[y], at[x], at[y], least)
                x, y = x[some], y[some]
                room = n[x] + n[y] - 2 * -(-p * (n[x] + n[y]) // (p + q))
                some = held.apart(x, y) <= room
                x, y = node[x[some]], node[y[some]]
                pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            once = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], ["a", "b"])
        give_back()

    out = materialize(rows.mapInArrow(run, "a long, b long").distinct(), "rest")
    discard(near, marks)
    return out


def similar_texts(
    docs: DataFrame, words: int = 5, least: tuple[int, int] = (4, 5), lengths: int = 4, tables: int = 3, blocks: int = 8, agree: int = 2,
    distance: int = 56, seed: int = 42, chunk: int = 1000,
) -> DataFrame:
    """(doc_id, component_id) for every row of docs(doc_id, text): components of texts
    whose shingle sets have Jaccard similarity of at least least[0] / least[1]. Most are
    found by `agree` of `blocks` pieces in one of `tables` fingerprints and at most
    `distance` bits in all `lengths`, all others by rest_links(); these numbers change the
    time it takes and not the result. Texts of equal sets are one class before anything is
    joined."""
    if not 0 < agree <= blocks <= 64 or not 0 < tables <= lengths:
        raise ValueError("agree must not exceed blocks, nor tables lengths")
    if not 0 < least[0] <= least[1]:
        raise ValueError("the similarity must be above 0 and not above 1")
    small_batches(docs.sparkSession)
    marked = materialize(described(docs, words, lengths, seed), "described")
    first = marked.groupBy("class").agg(F.min_by(F.struct("n", "fps", "part"), F.col("doc_id")).alias("r"), F.min("doc_id").alias("node"))
    classes = materialize(first.select("class", "node", "r.*"), "classes")
    known = classes.where("node is not null")
    met = materialize(_similar_links(known, least, lengths, tables, blocks, agree, distance, chunk), "met")
    pairs = materialize(bounded(met, known, least), "pairs")
    discard(met)
    found = components(verified(pairs, docs, words, least, seed))
    rest = rest_links(docs, marked, classes, found, words, least, seed, chunk)
    more = materialize(verified(rest, docs, words, least, seed), "more")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))
    named = classes.join(found, "node", "left").select("class", F.coalesce("component", "node").alias("component_id"))
    return marked.select("doc_id", "class").join(named, "class").select("doc_id", "component_id")
