"""URL rules by a Bloom filter cascade, in DataFrame functions only.

A rule is a host and a path prefix. The keys of a url are its host suffixes
times its path prefixes of the lengths that rules have. Per action, level 0 of a
cascade encodes the listed keys, level 1 the unlisted keys of the corpus that
level 0 lets through, level 2 the listed keys that level 1 lets through, and so
on until nothing is let through wrongly. Over the corpus's complete key
universe membership is then exact, and urls are judged without a join: the
filters are constants of a few words per listed key, checked against
`max_words` before they enter a plan. A list whose cascade would exceed that is
held against the corpus's different urls by a join instead, with the same verdicts.

Defined cases: a null url or one without `://` has an empty host and path and
fits no rule unless one is empty; repeated rows are judged alike; a key listed
under both actions is blocked; no rules or no rows give the default verdict or
no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]


class TooManyKeys(ValueError):
    """A level of a cascade would not be a constant of bounded size."""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix with every path prefix, longest key first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])) if lengths else F.expr("cast(array() as array<string>)")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct((-F.length(s) - F.length(p)).alias("n"), (-F.length(s)).alias("h"), F.concat(s, p).alias("k")))))
    return F.transform(F.array_sort(keys), lambda x: x["k"])


def _slots(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    a, b = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    return [F.pmod(F.shiftright(a, 1) + F.lit(j) * F.shiftright(b, 8), F.lit(bits)).cast("int") for j in range(hashes)]


def passes(key: Column, number: int, level: Level) -> Column:
    """Whether a level lets the key through."""
    words = F.array(*[F.lit(w).cast("long") for w in level.words]) if len(level.words) < 64 else F.lit(list(level.words)).cast("array<long>")
    tests = [F.getbit(F.get(words, F.shiftright(s, 6)), s.bitwiseAND(F.lit(63))) == 1 for s in _slots(key, number, level.bits, level.hashes)]
    return reduce(lambda x, y: x & y, tests)


def listed(key: Column, levels: list[Level]) -> Column:
    """Exact membership for keys of the universe."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(passes(key, i, levels[i]), out).otherwise(F.lit(i % 2 == 1))
    return out


def build(universe: DataFrame, max_words: int = 1 << 17) -> list[Level]:
    """Cascade over universe(key, listed): all corpus keys and all listed keys.

    The first level's rate shrinks with the universe, as the square root of a
    half times listed over unlisted, so later levels stay as small as the list.
    """
    levels: list[Level] = []
    left = universe
    total, n = universe.agg(F.count("*"), F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0))).first()
    while n:
        side = len(levels) % 2 == 0
        rate = min(0.5, math.sqrt(0.5) * n / max(1, total - n)) if not levels else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(n * hashes / math.log(2)))
        count = -(-bits // 64)
        if count > max_words:
            raise TooManyKeys(f"a filter of {count} words exceeds max_words={max_words}")
        slot = F.explode(F.array(*_slots(F.col("key"), len(levels), bits, hashes)))
        ones = (
            left.where(F.col("listed") == side).select(slot.alias("s"))
            .groupBy(F.shiftright("s", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("v"))
        )
        words = [0] * count
        for w, v in ones.collect():  # at most max_words rows
            words[w] = v
        levels.append(Level(bits, hashes, tuple(words)))
        left = left.where((F.col("listed") == side) | passes(F.col("key"), len(levels) - 1, levels[-1]))
        n = left.where(F.col("listed") != side).count()
    return levels


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow", max_words: int = 1 << 17) -> DataFrame:
    """pages(page_id, url) and rules(host, path, action) -> verdict per page."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    # One row per distinct length: bounded by the longest rule path.
    lengths = sorted(r[0] for r in rules.where("path is not null").select(F.length("path")).distinct().collect())
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    rule_key = F.concat(F.translate("host", UPPER, LOWER), F.col("path"))
    corpus = urls.select("host", "path").distinct().select(F.explode(keys).alias("key"))
    flags = corpus.select("key", F.lit(False).alias("block"), F.lit(False).alias("allow")).unionAll(
        rules.where("host is not null and path is not null").select(rule_key.alias("key"), (F.col("action") == "block").alias("block"), (F.col("action") == "allow").alias("allow"))
    )
    universe = materialize(flags.groupBy("key").agg(F.max("block").alias("block"), F.max("allow").alias("allow")), "keys")
    try:
        filters = {x: build(universe.select("key", F.col(x).alias("listed")), max_words) for x in ("block", "allow")}
    except TooManyKeys:
        return _judge_by_join(urls, universe, keys, default)

    def any_(k: Column) -> Column:
        return listed(k, filters["block"]) | listed(k, filters["allow"])

    found = urls.withColumn("rule", F.get(F.filter(keys, any_), F.lit(0)))
    blocked = F.coalesce(listed(F.col("rule"), filters["block"]), F.lit(False))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocked, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _judge_by_join(urls: DataFrame, universe: DataFrame, keys: Column, default: str) -> DataFrame:
    """judge() for lists too long for constants: each different url's keys are joined to
    the listed ones, and the longest counts. Urls are joined back by host and path."""
    known = universe.where("block or allow").select("key", "block")
    asked = urls.select("host", "path").distinct().select("host", "path", F.posexplode(keys).alias("at", "key"))
    best = asked.join(known, "key").groupBy("host", "path").agg(F.min_by(F.struct("key", "block"), F.col("at")).alias("best"))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.block"), "block").otherwise("allow")
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))
