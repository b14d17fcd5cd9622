"""Token ids in a content-addressed store.

Layout under the store's folder:
  packs/*.ids      zstd streams of chunks of ids, little-endian, back to back
  index/           parquet: digest, pack, offset, n_ids of every stored chunk
  recipes/         parquet: root, digests - the chunks of each different document
  documents/       parquet, ascending doc_id: doc_id, root
  manifest/        parquet: pack, n_chunks, merkle - the Merkle root of each pack

A rolling hash over the ids decides where a chunk ends, so equal passages give
equal chunks. A document is named by the Merkle root of its chunks. Encoding
tasks write packs of chunks that are new to the task; a chunk that several tasks
wrote is kept in one pack only, chosen by a minimum over digests (16 bytes a
chunk are shuffled, never the ids), and packs are rewritten without the rest.

Reading goes the other way: packs are read, every chunk's digest and every
pack's Merkle root verified, and documents put together from their recipes.

Only packs named in a committed table count. Defined cases: null text is empty
and has the end id only; a null doc_id sorts first; equal rows share a recipe;
no rows give an empty store; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import discard, materialize, new_path, remove, temporary
from .idmemo import HashedMemo
from .memory import give_back, small_batches

MEMO, PER_CALL, PER_TEXT, PIECE = 2_000_000, 2048, 64, 1 << 23
WINDOW, MEAN, LEAST, MOST, DIGEST = 8, 512, 64, 4096, 16
#: Classes of characters: white space, letters, numbers, all others, and those whose class may differ between libraries.
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level models write the other bytes as the characters from 256 on.
_BYTES = dict(zip((b for b in range(256) if b not in _PLAIN), range(256, 512)))
_SHOWN = np.array([_BYTES.get(b, b) for b in range(256)], "<u2")
#: Bytes that UTF-8 never holds.
_NEVER = (0xC0, 0xC1, *range(0xF5, 0x100))
# What byte-level models split off after an apostrophe.
_SHORT = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


_CUT = re.compile(rb" (?=[!-~])")


def _shown(raw: bytes) -> str:
    """Bytes as byte-level models write them."""
    return _SHOWN[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le")


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point. Letters and numbers that an early Unicode lacked, and
    code points without a character, are unsure; so are most control characters."""
    early, out = unicodedata.ucd_3_2_0.category, np.full(0x110000, OTHER, np.uint8)
    for c in range(1 << 17):
        kind, old = unicodedata.category(x := chr(c)), early(x)
        if kind in ("Cn", "Cc") or kind[0] != old[0] and (kind[0] in "LNZ" or old[0] in "LNZ"):
            out[c] = UNSURE
        else:
            out[c] = {"L": LETTER, "N": NUMBER, "Z": SPACE}.get(kind[0], OTHER)
    out[9:14] = SPACE
    out[1 << 17:] = UNSURE
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of some UTF-8 text belongs to."""
    table = classes()
    out = table[:128].take(data, mode="clip")
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
        kind = table[code]
        for k in range(4):
            out[lead[size > k] + k] = kind[size > k]
    return out


def groups(data: np.ndarray, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the groups into which byte-level models split texts that lie back to
    back in `data`; `ends` are the texts' ends, none of them empty.

    A run of one class is a group. Of white space before something else the last
    character is by itself, and a space joins what follows. An apostrophe that
    starts a group takes some endings with it."""
    n = len(data)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[ends[:-1]] = True
    follows = np.flatnonzero(start & (kind != SPACE))
    follows = follows[1:] if len(follows) and follows[0] == 0 else follows
    follows = follows[kind[follows - 1] == SPACE]  # something after white space
    if len(ends) > 1:
        begins = np.zeros(n, bool)
        begins[ends[:-1]] = True
        follows = follows[~begins[follows]]
    last = follows - 1
    for _ in range(2):
        last = last - (data[last] & 0xC0 == 0x80)
    start[last] = True
    start[follows[data[last] == 32]] = False
    quote = np.flatnonzero(start & (data == 39))
    if len(quote):
        limit = ends[np.searchsorted(ends, quote, "right")]
        padded = np.r_[data, np.zeros(3, np.uint8)]
        for tail in _SHORT:
            fits = quote + 1 + len(tail) <= limit
            for k, c in enumerate(tail):
                fits &= padded[quote + 1 + k] == c
            q = quote[fits]
            start[q + 1] = False
            after = q + 1 + len(tail)
            start[after[after < limit[fits]]] = True
    return np.flatnonzero(start)


class Encoder:
    """The tokenizers library with a memo over the groups that byte-level models split
    texts into before they look at the merges.

    Many texts are split at once by the classes of their bytes; equal groups of a
    batch are one, and those that the memo lacks go through the library's model,
    many at a time: a byte that UTF-8 never holds and no merge names ends each, so
    no merge reaches over it and the model needs no splitting of its own. Groups,
    ids and lookups stay in arrays. A memo that is full keeps what the batch at
    hand has of it. Texts with characters whose class is unsure, or that hold one
    of the model's added tokens, and models of another kind, are encoded whole by
    the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.splits = bool(
            model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and not spec.get("post_processor")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        if self.splits:
            merged = set().union(*("".join(m) for m in model["merges"]))
            self.parting = next((bytes([b]) for b in _NEVER if _shown(bytes([b])) not in merged and _shown(bytes([b])) in model["vocab"]), None)
            self.splits = self.parting is not None
        if self.splits:
            self.stop = self.lib.token_to_id(_shown(self.parting))
            self.groups = Tokenizer(self.lib.model)  # one model in memory
        self.memo = HashedMemo(MEMO)

    def _solve(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some groups has, and all their ids."""
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(keys), PER_CALL):
            part = keys[at:at + PER_CALL]
            texts = [_shown(self.parting.join([*part[k:k + PER_TEXT], b""])) for k in range(0, len(part), PER_TEXT)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.groups.encode_batch_fast(texts, add_special_tokens=False)])
            stops = np.flatnonzero(ids == self.stop)
            if len(stops) != len(part) or stops[-1] != len(ids) - 1:
                raise ValueError("the tokenizer merges across groups")
            sizes.append(np.diff(stops, prepend=-1) - 1)
            flat.append(ids[ids != self.stop])
        return np.concatenate(sizes), np.concatenate(flat)

    def _split(self, data: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> list[bytes]:
        """Ids of texts that lie back to back, none of them empty."""
        starts = groups(data, kind, ends)
        ids, n = self.memo.ids(data, starts, self._solve)
        raw, upto = ids.tobytes(), np.cumsum(n, dtype=np.int64)
        cuts = [0, *(4 * upto[np.searchsorted(starts, ends) - 1]).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _pieces(self, text: bytes) -> list[bytes]:
        """A long text cut before spaces that something follows, where groups start anyway."""
        out, at = [], 0
        while len(text) - at > PIECE and (found := _CUT.search(text, at + PIECE)):
            out.append(text[at:found.start()])
            at = found.start()
        return [*out, text[at:]]

    def _settle(self, waiting: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        """Appends the ids of each waiting piece to those of its text."""
        data = np.frombuffer(b"".join([p for _, p in waiting]), np.uint8)
        ends = np.cumsum([len(p) for _, p in waiting])
        kind = byte_classes(data)
        whole = np.zeros(len(waiting), bool)
        whole[np.searchsorted(ends, np.flatnonzero(kind == UNSURE), "right")] = True
        if whole.any():
            fits = np.repeat(~whole, np.diff(ends, prepend=0))
            data, kind = data[fits], kind[fits]
            ends = np.cumsum([len(p) for (_, p), w in zip(waiting, whole) if not w])
        split = iter(self._split(data, ends, kind) if len(data) else [])
        alone = iter(self._library([p.decode() for (_, p), w in zip(waiting, whole) if w]))
        for (i, _), w in zip(waiting, whole):
            out[i].append(next(alone if w else split))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.splits or any(a in t for a in self.added):
                out[i] = self._library([t])
                continue
            for piece in self._pieces(t.encode()):
                waiting.append((i, piece))
                size += len(piece)
                if size > PIECE:
                    self._settle(waiting, out)
                    waiting, size = [], 0
        if waiting:
            self._settle(waiting, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree; leaves and nodes are hashed apart."""
    level = [_hash(b"\x00" + d) for d in digests] or [_hash(b"")]
    while len(level) > 1:
        level = [_hash(b"\x01" + b"".join(level[k:k + 2])) for k in range(0, len(level), 2)]
    return level[0]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of the windows of WINDOW ids, a power of two, whose hash has its low bits zero."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        x ^= x >> np.uint64(29)
        base, size = np.uint64(0xD1342543DE82EF95), 1
        while size < WINDOW:  # a polynomial in the base: two windows side by side make one of twice the size
            h = x[:-size] * base
            h += x[size:]
            x, base, size = h, base * base, 2 * size
        h = x ^ (x >> np.uint64(32))
    return np.flatnonzero(h & np.uint64(MEAN - 1) == 0) + WINDOW


def cuts(ids: np.ndarray, bounds: np.ndarray | None = None) -> list[list[int]] | list[int]:
    """Chunk ends, at least LEAST and at most MOST ids apart, at the marks of the ids.
    With `bounds`, the ends of texts that lie back to back: a list for each, counted
    from its own start; a window never crosses a bound."""
    if bounds is None:
        return cuts(ids, np.array([len(ids)]))[0]
    found, out, begin = marks(ids), [], 0
    upto = np.searchsorted(found, bounds, "right")
    since = np.searchsorted(found, np.r_[0, bounds[:-1]] + WINDOW)
    for end, lo, hi in zip(bounds.tolist(), since.tolist(), upto.tolist()):
        n, last, mine = end - begin, 0, []
        for e in [*(found[lo:hi] - begin).tolist(), n]:
            while e - last > MOST:
                last += MOST
                mine.append(last)
            if e > last and (e - last >= LEAST or e == n):
                last = e
                mine.append(e)
        out.append(mine)
        begin = end
    return out


_zeros = b"\x00" * (4 * MOST)


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a whole from the (crc, bytes) of its parts, in order."""
    total = 0
    for crc, size in parts:
        z = _zeros[:size]
        total = zlib.crc32(z, total) ^ zlib.crc32(z) ^ crc
    return total


_ROWS = "kind string, doc_id long, root binary, digests binary, digest binary, pack string, offset long, n_ids long"


def _encode(docs: DataFrame, folder: str, path: str, end: int, seen_most: int = 200_000) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        pack, offset, seen, tail, enc = f"{uuid.uuid4().hex}.ids", 0, set(), np.array([end], "<u4").tobytes(), encoder(path)
        gc.disable()  # the groups make no cycles, and being looked through again and again they take time
        try:
            with fs.open_output_stream(f"{base}/{pack}", compression="zstd") as out:
                for whole in batches:
                    gc.collect(1)  # what outlived one look is not looked through again
                    for at in range(0, len(whole), 2048):
                        batch, rows = whole.slice(at, 2048), []
                        coded = [x + tail for x in enc.encode(batch.column(1).to_pylist())]
                        ends = cuts(np.frombuffer(b"".join(coded), "<u4"), np.cumsum([len(x) // 4 for x in coded]))
                        for doc, data, mine in zip(batch.column(0).to_pylist(), coded, ends):
                            last, digests = 0, []
                            for e in mine:
                                chunk = data[4 * last:4 * e]
                                d = _hash(chunk)
                                digests.append(d)
                                if d not in seen:
                                    if len(seen) >= seen_most:
                                        seen.clear()
                                    seen.add(d)
                                    out.write(chunk)
                                    rows.append(("chunk", None, None, None, d, pack, offset, e - last))
                                    offset += len(chunk)
                                last = e
                            rows.append(("doc", doc, merkle(digests), b"".join(digests), None, None, None, None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
        finally:
            gc.enable()
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _ROWS)


_ARROW = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("root", pa.binary()), ("digests", pa.binary()), ("digest", pa.binary()), ("pack", pa.string()), ("offset", pa.int64()), ("n_ids", pa.int64())])


def _compact(kept: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each pack with its kept chunks; returns the new index."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["offset", "digest"]).drop_duplicates("digest")
        fs, base = pafs.FileSystem.from_uri(source)
        to, top = pafs.FileSystem.from_uri(target)
        to.create_dir(top, recursive=True)
        pack, offset, rows = f"{uuid.uuid4().hex}.ids", 0, []
        with fs.open_input_stream(f"{base}/{group['pack'].iloc[0]}", compression="zstd") as f, to.open_output_stream(f"{top}/{pack}", compression="zstd") as out:
            at = 0
            for digest, start, n in zip(group["digest"], group["offset"], group["n_ids"]):
                while at < start:
                    at += len(f.read(min(start - at, 1 << 20)))
                out.write(f.read(4 * n))
                at += 4 * n
                rows.append((digest, pack, offset, n))
                offset += 4 * n
        return pd.DataFrame(rows, columns=["digest", "pack", "offset", "n_ids"])

    n = max(1, kept.select("pack").distinct().count())
    return kept.repartition(2 * n, "pack").groupBy("pack").applyInPandas(run, "digest binary, pack string, offset long, n_ids long")


def write(docs: DataFrame, folder: str, path: str, end: int = 0) -> None:
    """Encode docs(doc_id, text) with the tokenizer file at `path` into a store."""
    rows = materialize(_encode(docs, f"{folder}/new", path, end), "encoded")
    chunks = rows.where("kind = 'chunk'").select("digest", "pack", "offset", "n_ids")
    place = F.struct("pack", "offset", "n_ids")
    kept = chunks.groupBy("digest").agg(F.min(place).alias("p")).select("digest", "p.*")
    index = materialize(_compact(kept, f"{folder}/new", f"{folder}/packs"), "index", f"{folder}/index")
    found = rows.where("kind = 'doc'")
    materialize(found.groupBy("root").agg(F.min("digests").alias("digests")), "recipes", f"{folder}/recipes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.select("doc_id", "root").repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    materialize(ordered, "documents", f"{folder}/documents")
    materialize(_manifest(index), "manifest", f"{folder}/manifest")
    remove(docs.sparkSession, f"{folder}/new")
    discard(rows)


def _manifest(index: DataFrame) -> DataFrame:
    """Merkle root per pack, over its chunks by offset."""

    @F.pandas_udf("binary")
    def root(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ds: merkle([bytes(d) for d in ds]))

    lists = index.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("offset", "digest"))).alias("c"))
    return lists.select("pack", F.size("c").cast("long").alias("n_chunks"), root(F.transform("c", lambda x: x["digest"])).alias("merkle"))


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n_ids, crc) of every stored chunk, read from the packs and verified."""
    index, manifest = spark.read.parquet(f"{folder}/index"), spark.read.parquet(f"{folder}/manifest")
    n = max(1, manifest.count())
    group = index.join(manifest, "pack").repartition(2 * n, "pack").groupBy("pack")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("offset")
        fs, base = pafs.FileSystem.from_uri(f"{folder}/packs")
        crcs, seen = [], []
        with fs.open_input_stream(f"{base}/{group['pack'].iloc[0]}", compression="zstd") as f:
            for digest, size in zip(group["digest"], group["n_ids"]):
                data = f.read(4 * size)
                if _hash(data) != bytes(digest):
                    raise ValueError(f"chunk differs from its digest in {group['pack'].iloc[0]}")
                crcs.append(zlib.crc32(data))
                seen.append(bytes(digest))
        if merkle(seen) != bytes(group["merkle"].iloc[0]) or len(seen) != group["n_chunks"].iloc[0]:
            raise ValueError(f"pack {group['pack'].iloc[0]} differs from its manifest")
        return pd.DataFrame({"digest": group["digest"], "n_ids": group["n_ids"], "crc": crcs})

    return group.applyInPandas(run, "digest binary, n_ids long, crc long")


def _pieces_of(recipes: DataFrame) -> DataFrame:
    """(root, k, digest) of every chunk of every recipe."""
    pieces = F.expr(f"transform(sequence(0, cast(length(digests) div {DIGEST} - 1 as int)), k -> substring(digests, k * {DIGEST} + 1, {DIGEST}))")
    return recipes.select("root", F.posexplode(pieces).alias("k", "digest"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the store's files.

    Checksums of chunks are combined instead of moving ids. Recipes are unique, so
    copies of a document cost one row; `start` is a running total inside each
    sorted part plus the totals of the parts before it."""
    recipes = spark.read.parquet(f"{folder}/recipes")

    parts = _pieces_of(recipes).join(read_chunks(spark, folder), "digest", "left")
    whole = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("k", "digest", "crc", "n_ids"))).alias("c"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.flatten()
            begin, (_, digest, crc, n) = int(ends[0]), (flat.field(k) for k in range(4))
            if n.null_count:
                raise ValueError("a recipe names a chunk that is not stored")
            digest, crc, n = digest.to_pylist(), crc.to_pylist(), n.to_pylist()
            sums, crcs = [], []
            for root, i, j in zip(b.column(0).to_pylist(), (ends[:-1] - begin).tolist(), (ends[1:] - begin).tolist()):
                if merkle(digest[i:j]) != root:
                    raise ValueError("a recipe differs from its root")
                sums.append(sum(n[i:j]))
                crcs.append(joined_crc([(c, 4 * x) for c, x in zip(crc[i:j], n[i:j])]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.int64()), pa.array(crcs, pa.int64())], ["root", "n", "crc"])

    checked = whole.mapInArrow(combine, "root binary, n long, crc long")
    docs = spark.read.parquet(f"{folder}/documents").join(checked, "root")
    return _running(docs)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) of every document, put together from its recipe and the packs, whose
    chunks are verified; ids are little-endian unsigned 32-bit integers with the end id."""
    index, manifest = spark.read.parquet(f"{folder}/index"), spark.read.parquet(f"{folder}/manifest")
    packs = index.repartition(2 * max(1, manifest.count()), "pack").groupBy("pack")

    def read(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("offset")
        fs, base = pafs.FileSystem.from_uri(f"{folder}/packs")
        with fs.open_input_stream(f"{base}/{group['pack'].iloc[0]}", compression="zstd") as f:
            data = [f.read(4 * n) for n in group["n_ids"]]
        if any(_hash(x) != bytes(d) for x, d in zip(data, group["digest"])):
            raise ValueError(f"chunk differs from its digest in {group['pack'].iloc[0]}")
        return pd.DataFrame({"digest": group["digest"].to_numpy(), "data": data})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [b"".join(x["data"] for x in c) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.binary())], ["root", "ids"])

    parts = _pieces_of(spark.read.parquet(f"{folder}/recipes")).join(packs.applyInPandas(read, "digest binary, data binary"), "digest")
    whole = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("k", "data"))).alias("c")).mapInArrow(join, "root binary, ids binary")
    return spark.read.parquet(f"{folder}/documents").join(whole, "root").select("doc_id", "ids")


def _running(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "n", "crc", "root").repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            n = b.column(1).to_numpy()
            ends = total + np.cumsum(n)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends - n), b.column(1), b.column(2)], ["doc_id", "inner", "n", "crc"])

    local = materialize(ordered.mapInArrow(run, "doc_id long, inner long, n long, crc long").withColumn("part", F.spark_partition_id()), "running")
    sums = local.groupBy("part").agg(F.sum("n").alias("s"))  # a row per part
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"))
    return local.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("inner")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"),
    )


def store_and_read(docs: DataFrame, path: str, end: int = 0, folder: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    target = folder or new_path(spark, "store")
    write(docs, target, path, end)
    if folder is None:
        temporary(spark, target)
    return read_documents(spark, target)
