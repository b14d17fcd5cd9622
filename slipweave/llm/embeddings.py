"""Embedding near-duplicates by spherical-cap filters.

Filter directions form a random product code: after a random rotation a vector
is cut in two halves, each half has `codes` random unit directions, and a filter
is one direction from each. The cap size is set so that a vector exceeds EXPECTED
filters on average; all of them are list-decoded from the two short lists of
half products without visiting the rest. A vector that exceeds fewer than FLOOR gets
a cap as wide as that takes, and TABLES codes have rotations of their own: so no
vector is served badly. Vectors meet in the tasks of
their first half's code; a pair links when it shares a whole filter and its cosine
in double precision reaches the threshold, whatever else is in the group.

A pair may share several filters. A row carries the numbers of all its vector's
filters (two bytes each), so the pair is counted in the group of the smallest
filter it shares and nowhere else: links are added up where they are found, and
pairs never leave a task. What goes on is a count per vector and group, summed by
Spark, and a spanning forest of each group's links for the components.

Equal vectors are one class before the join. A code held by many classes is
dealt over pairs of chunks, so no task sees more than two chunks at a time.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length never link; equal
rows are separate vectors that link; a null vec_id is kept with a null
component unless its class has an id. vec_id names a vector: rows that repeat it
with different vectors are joined through it. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize
from .components import components
from .simhash import forest, groups_of

#: Codes, a vector's filters in each: on average, and at least; sizes tried for a code.
TABLES, EXPECTED, FLOOR, SIZES = 2, 20, 24, (1 << 16, 1 << 14, 1 << 12, 1 << 10, 1 << 8)
#: Rows of 20 bytes that are broadcast at most.
MOST_CODES = 200_000
#: Vectors shorter than this are not cut in halves.
SHORT = 16


def cap(dim: int, share: float) -> float:
    """Cosine at the edge of the cap that holds this share of the sphere."""
    angle = np.linspace(0, np.pi, 20001)
    density = np.sin(angle) ** max(0, dim - 2)
    total = np.cumsum(density)
    return float(np.cos(angle[np.searchsorted(total, share * total[-1])]))


@lru_cache(32)
def code(dim: int, cosine: float, seed: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Rotation, the halves' directions and the threshold for one length.

    The code is the largest in SIZES whose caps still hold a vector's partner at
    `cosine` with probability of a fifth; short vectors need larger caps."""
    rnd = np.random.default_rng([seed, dim])
    for size in SIZES if dim >= SHORT else SIZES[-2:]:
        share = min(0.4, EXPECTED / size)
        edge = cap(dim, share)
        x = np.full(4000, edge)
        z = rnd.normal(size=(4000, max(2, dim - 1)))[:, :max(1, dim - 1)]
        z = z[:, 0] / np.maximum(np.linalg.norm(z, axis=1), 1e-12)
        if np.mean(cosine * x + np.sqrt(1 - cosine**2) * np.sqrt(1 - x**2) * z >= edge) >= 0.2:
            break
    turn = np.linalg.qr(rnd.normal(size=(dim, dim)))[0]
    if dim < SHORT:  # one list of directions; the second half is empty
        first = rnd.normal(size=(size, dim))
        return turn, [first / np.linalg.norm(first, axis=1, keepdims=True), np.zeros((1, 0))], edge
    halves = []
    for d in (dim // 2, dim - dim // 2):
        c = rnd.normal(size=(round(size**0.5), d))
        halves.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return turn, halves, edge * np.sqrt(2)


def decode(vectors: np.ndarray, cosine: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first code, second code) of every filter that a unit vector exceeds, or of its best FLOOR."""
    dim = vectors.shape[1]
    turn, (c1, c2), edge = code(dim, cosine, seed)
    turned = vectors @ turn
    s1, s2 = turned[:, :c1.shape[1]] @ c1.T, turned[:, c1.shape[1]:] @ c2.T
    # The best sums of two are among those of the best of each half.
    some = [np.partition(s, -min(FLOOR, s.shape[1]), axis=1)[:, -min(FLOOR, s.shape[1]):] for s in (s1, s2)]
    sums = (some[0][:, :, None] + some[1][:, None, :]).reshape(len(s1), -1)
    least = np.partition(sums, -min(FLOOR, sums.shape[1]), axis=1)[:, -min(FLOOR, sums.shape[1])]
    edge = np.minimum(edge, least)
    row, first = np.nonzero(s1 + s2.max(axis=1, keepdims=True) >= edge[:, None])
    out = []
    for k in range(0, len(row), 1 << 12):
        r, f = row[k:k + (1 << 12)], first[k:k + (1 << 12)]
        at, second = np.nonzero(s2[r] >= (edge[r] - s1[r, f])[:, None])
        out.append((r[at], f[at], second))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their length, in double precision and without overflow."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(vector):
    """Column: not null, not empty, every component finite, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _decoded(batch: pa.RecordBatch, at: int, cosine: float, seed: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(dim, rows, (row, first, filter) of every code) for the vectors in column `at`."""
    dims = np.diff(batch.column(at).offsets.to_numpy())
    for dim in np.unique(dims):
        mine = np.flatnonzero(dims == dim)
        flat = batch.column(at).take(pa.array(mine)).flatten().to_numpy().reshape(-1, dim)
        vectors, found = unit(flat), []
        for t in range(TABLES):
            row, first, second = decode(vectors, cosine, seed + t)
            order = np.lexsort((second, first, row))
            wide = len(code(dim, cosine, seed + t)[1][1])
            found.append((row[order], first[order], first[order] * wide + second[order]))
        yield int(dim), mine, found


def code_sizes(classes: DataFrame, cosine: float, seed: int, chunk: int) -> DataFrame:
    """(t, dim, c1, m): the number of chunks of every first code that a class holds.
    There are no more rows than codes, TABLES times a few hundred for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                for dim, _, found in _decoded(whole.slice(at, 1024), 2, cosine, seed):
                    for t, (row, first, _) in enumerate(found):
                        held = first[np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (first[1:] != first[:-1])])] if len(row) else first
                        c1, n = np.unique(held, return_counts=True)
                        kinds = np.full(len(c1), t, np.int32), np.full(len(c1), dim, np.int32), c1.astype(np.int32), n.astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kinds], ["t", "dim", "c1", "n"])

    # The columns of filtered(): the same batches, so the same products to the last bit.
    found = classes.select("node", "n", "embedding").mapInArrow(run, "t int, dim int, c1 int, n long")
    total = found.groupBy("t", "dim", "c1").agg(F.sum("n").alias("n"))
    return total.select("t", "dim", "c1", F.ceil(F.col("n") / chunk).cast("int").alias("m"))


def filtered(classes: DataFrame, cosine: float, seed: int) -> DataFrame:
    """(t, dim, c1, node, n, vec, filters): a row per class, code and first direction.
    `filters` holds, for each code, how many filters the vector exceeds (four bytes) and
    then their numbers, ascending code by code (two bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                for dim, mine, found in _decoded(batch, 2, cosine, seed):
                    part = batch.take(pa.array(mine))
                    counts = np.stack([np.bincount(row, minlength=len(mine)) for row, _, _ in found], axis=1).astype("<u4")
                    row = np.concatenate([row for row, _, _ in found])
                    ids = np.concatenate([x for _, _, x in found]).astype("<u2")[np.argsort(row, kind="stable")]
                    ends = np.cumsum(counts.sum(axis=1)).tolist()
                    packed = pa.array([c.tobytes() + ids[i:j].tobytes() for c, i, j in zip(counts, [0, *ends], ends)], pa.binary())
                    for t, (row, first, _) in enumerate(found):
                        if not len(row):
                            continue
                        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (first[1:] != first[:-1])])
                        picked = pa.array(row[new])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(new), t, np.int32)), pa.array(np.full(len(new), dim, np.int32)), pa.array(first[new].astype(np.int32)),
                            *[part.column(k).take(picked) for k in range(3)], packed.take(picked),
                        ], ["t", "dim", "c1", "node", "n", "vec", "filters"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("node", "n", "embedding").mapInArrow(run, f"t int, dim int, c1 int, node long, n long, vec {kind}, filters binary")


def unpacked(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of every filter in packed lists; a number holds its code in the high bits."""
    counts = np.frombuffer(b"".join([x[:4 * TABLES] for x in filters]), "<u4").reshape(-1, TABLES).astype(np.int64)
    ids = np.frombuffer(b"".join([x[4 * TABLES:] for x in filters]), "<u2").astype(np.int64)
    table = np.repeat(np.tile(np.arange(TABLES), len(filters)), counts.ravel())
    return np.repeat(np.arange(len(filters)), counts.sum(axis=1)), table << 16 | ids


def _marks(row: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    """A row of bits per vector for the numbers that two vectors share."""
    kinds, at, times = np.unique(number, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    shared = times[at] > 1
    bit = place[at[shared]]
    out = np.zeros((n, (int(place[-1]) + 64) // 64 if len(kinds) else 0), np.uint64)
    np.bitwise_or.at(out, (row[shared], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _meet(marks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 15):
        out[k:k + (1 << 15)] = (marks[a[k:k + (1 << 15)]] & marks[b[k:k + (1 << 15)]]).any(axis=1)
    return out


def _close(vec: np.ndarray, chunks: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs a < b of unit vectors within the cosine; with `chunks`, of different ones only.
    Products by blocks decide all but the pairs within rounding of the threshold."""
    left, right = [], []
    for k in range(0, len(vec), 256):
        found = vec[k:k + 256] @ vec[k:].T
        a, b = np.nonzero(found >= cosine - 1e-9)
        sure = found[a, b] >= cosine + 1e-9
        keep = b > a
        a, b = a + k, b + k
        if chunks is not None:
            keep &= chunks[a] != chunks[b]
        near = np.flatnonzero(keep & ~sure)
        keep[near] = np.einsum("ij,ij->i", vec[a[near]], vec[b[near]]) >= cosine
        left.append(a[keep].astype(np.int32))
        right.append(b[keep].astype(np.int32))
    return np.concatenate(left), np.concatenate(right)


def linked(vec: np.ndarray, filters: list[bytes], low: int, high: int, chunks: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group that link and whose smallest shared filter is in [low, high)."""
    a, b = _close(vec, chunks, cosine)
    if not len(a):
        return a, b
    met = np.zeros(len(vec), bool)  # few of a group without near copies
    met[a] = met[b] = True
    some, place = np.flatnonzero(met), np.cumsum(met, dtype=np.int32) - 1
    x, y = place[a], place[b]
    row, number = unpacked([filters[i] for i in some.tolist()])
    here, before = (number >= low) & (number < high), number < low
    good = _meet(_marks(row[here], number[here], len(some)), x, y)
    good[good] = ~_meet(_marks(row[before], number[before], len(some)), x[good], y[good])
    return a[good], b[good]


def links(classes: DataFrame, cosine: float = 0.9, seed: int = 7, chunk: int = 3000) -> DataFrame:
    """(a, b, m): for classes(node, n, embedding), rows with b null give how many vectors of
    other classes link with a vector of class a, to be summed; the others are a spanning
    forest of the links."""
    sizes = materialize(code_sizes(classes, cosine, seed, chunk), "sizes")
    small = F.broadcast(sizes) if sizes.count() <= MOST_CODES else sizes  # vectors of hundreds of lengths
    rows = filtered(classes, cosine, seed).join(small, ["t", "dim", "c1"], "left")
    rows = rows.withColumn("m", F.coalesce("m", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least(j, F.col("chunk")).alias("i"), F.greatest(j, F.col("chunk")).alias("j")))
    rows = rows.withColumn("chunk", mine).withColumn("task", F.explode(tasks))
    keys = ["t", "dim", "c1", "i", "j"]
    rows = rows.select("t", "dim", "c1", "task.i", "task.j", "chunk", "node", "n", "vec", "filters")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, keys, most=4096):
            table = table.combine_chunks()
            col = {c: table[c].to_numpy() for c in (*keys, "chunk", "node", "n")}
            new = np.zeros(len(table), bool)
            for k in keys:
                new[1:] |= col[k][1:] != col[k][:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(table)]
            for lo, hi in zip(cuts, cuts[1:]):
                part = table.slice(lo, hi - lo)
                vec = unit(part["vec"].combine_chunks().flatten().to_numpy().reshape(hi - lo, -1))
                t, dim, c1, i, j = (int(col[k][lo]) for k in keys)
                wide = len(code(dim, cosine, seed + t)[1][1])
                low = (t << 16) + c1 * wide
                a, b = linked(vec, part["filters"].to_pylist(), low, low + wide, col["chunk"][lo:hi] if i != j else None, cosine)
                if not len(a):
                    continue
                node, n = col["node"][lo:hi], col["n"][lo:hi].astype(np.float64)  # exact below 2^53
                m = np.bincount(a, n[b], len(vec)) + np.bincount(b, n[a], len(vec))
                some = np.flatnonzero(m)
                label = forest(len(vec), a, b)
                far = np.flatnonzero(label != np.arange(len(vec)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.r_[node[some], node[far]]), pa.array([None] * len(some) + node[label[far]].tolist(), pa.int64()),
                    pa.array(np.r_[m[some], np.zeros(len(far))].astype(np.int64)),
                ], ["a", "b", "m"])

    return rows.mapInArrow(run, "a long, b long, m long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, seed: int = 7, chunk: int = 3000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = usable(F.col("embedding"))
    classes = materialize(rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "classes")
    found = materialize(links(classes.where("node is not null"), cosine, seed, chunk), "links")
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("m"))
    found = components(found.where("b is not null").select("a", "b"))
    named = (
        classes.join(degree, "node", "left").join(found, "node", "left")
        .select("embedding", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    linked = rows.where(good).join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionAll(alone).withColumn("kept", kept)
