"""The core fold and join on small cases, and against a plain statement of the rules."""

import random

import pytest

from slipweave.conf import Settings, load
from slipweave.operators import images, quality, recognize, rows
from slipweave.schemas import FRAGMENTS

CASES = {
    "alone": ([("Espresso", 5, 50, 85, 70)], "Espresso"),
    "price first in the list": ([("3.20", 220, 52, 262, 71), ("Espresso", 5, 50, 85, 70)], "Espresso  3.20"),
    "two rows": ([("Bagel", 8, 40, 58, 58), ("Scone", 8, 90, 58, 108)], "Bagel\nScone"),
    "bottom first in the list": ([("Sum", 4, 500, 34, 518), ("Shop", 4, 12, 44, 30)], "Shop\nSum"),
    "wide gap": ([("Flat White", 0, 10, 100, 30), ("4.10", 500, 10, 540, 30)], "Flat White  4.10"),
    "narrow gap": ([("Oat", 0, 10, 30, 30), ("Milk", 36, 10, 76, 30)], "Oat Milk"),
    "overlap of two fifths": ([("a", 0, 0, 10, 20), ("b", 20, 12, 30, 32)], "a b"),
    "overlap of less": ([("a", 0, 0, 10, 20), ("b", 20, 13, 30, 33)], "a\nb"),
    "span of the whole row": ([("a", 0, 0, 10, 100), ("b", 20, 45, 30, 57), ("c", 40, 60, 50, 72)], "a b c"),
    "no height splits": ([("a", 0, 0, 10, 20), ("z", 0, 10, 10, 10), ("b", 0, 0, 10, 20)], "a\nz\nb"),
    "gap of three widths": ([("a", 0, 0, 10, 20), ("b", 40, 0, 50, 20)], "a b"),
    "boxes overlap": ([("abcdefgh", 0, 0, 80, 20), ("hello", 70, 0, 120, 20)], "abcdefgh hello"),
    "equal x": ([("b", 0, 1, 10, 21), ("a", 0, 0, 10, 20)], "a b"),
    "blank and zero-width": ([(" \t\xa0\u3000", 0, 0, 10, 20), ("\u200b", 0, 50, 10, 70)], "\u200b"),
}


def frame(spark, cases):
    data = [(k, i, t, float(a), float(b), float(c), float(d), 0.9) for k, (fs, _) in cases.items() for i, (t, a, b, c, d) in enumerate(fs)]
    return spark.createDataFrame(data, FRAGMENTS)


def test_cases(spark):
    names = list(CASES)
    cleaned = quality.clean(frame(spark, dict(enumerate(CASES.values()))))
    got = {names[r.receipt_id]: r.text for r in rows.reconstruct(cleaned).collect()}
    assert got == {k: want for k, (_, want) in CASES.items()}


def plain(fragments, threshold=0.4):
    out, row, lo, hi = {}, 0, 0.0, 0.0
    for k, (_, _, a, _, b) in sorted(enumerate(fragments), key=lambda f: ((f[1][2] + f[1][4]) / 2, f[0])):
        shared, short = min(hi, b) - max(lo, a), min(hi - lo, b - a)
        if row and shared > 0 and short > 0 and shared / short >= threshold:
            lo, hi = min(lo, a), max(hi, b)
        else:
            row, lo, hi = row + 1, a, b
        out[k] = row
    return out


def test_random_receipts(spark):
    rnd = random.Random(12)
    cases = {}
    for k in range(60):
        fs = []
        for _ in range(rnd.randint(1, 25)):
            x, y = rnd.randint(0, 300), rnd.randint(0, 120)
            fs.append(("w", x, y, x + rnd.randint(-5, 60), y + rnd.randint(-3, 40)))
        cases[k] = (fs, "")
    got = {}
    for r in rows.group_rows(frame(spark, cases)).collect():
        got.setdefault(r.receipt_id, {})[r.seq] = r.row_no
    assert got == {k: plain(fs) for k, (fs, _) in cases.items()}
    # Joining in one pass, and joining groups whose order was lost, give the same rows.
    fragments = frame(spark, cases)
    once = sorted(tuple(r) for r in rows.row_texts(fragments).collect())
    assert once == sorted(tuple(r) for r in rows.join_rows(rows.group_rows(fragments).orderBy("x2")).collect())
    whole = {r.receipt_id: (r.text, r.num_lines) for r in rows.receipts(fragments).collect()}
    assert whole == {k: ("\n".join(t for k2, _, t in once if k2 == k), len(fs)) for k, (fs, _) in cases.items()}


def test_one_long_receipt_and_string_keys(spark):
    n = 30_000
    data = [("long", i, f"w{i}", 0.0, 20.0 * (i // 3), 10.0, 20.0 * (i // 3) + 18, 0.5) for i in range(n)]
    data += [(None, 0, "no id", 0.0, 0.0, 10.0, 20.0, None)]
    found = spark.createDataFrame(data, "receipt string, seq int, text string, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = {r.receipt: r for r in rows.receipts(found, "receipt").collect()}
    assert got["long"].num_lines == n and got["long"].text.count("\n") == n // 3 - 1 and got["long"].avg_confidence == 0.5
    assert (got[None].text, got[None].avg_confidence) == ("no id", 0.0)
    assert rows.receipts(found.limit(0), "receipt").collect() == []
    assert rows.group_rows(found, "receipt").agg({"row_no": "max"}).first()[0] == n // 3


def test_status_edges(spark):
    data = [(1, 0.5), (1, 0.49996), (0, 0.0), (1, float("nan"))]
    got = [r.status for r in quality.with_status(spark.createDataFrame(data, "num_lines int, avg_confidence double")).collect()]
    assert got == ["ok", "low_confidence", "empty", "ok"]


def test_resize_edges(spark):
    from pyspark.sql import functions as F

    sizes = [(2560, 1000), (1000, 1), (3000, 4000), (400, 100), (5120, 5), (6000, 1)]
    found = spark.createDataFrame(sizes, "w int, h int").select(images.resize_bounds(F.col("w"), F.col("h")).alias("b")).select("b.*").collect()
    assert [tuple(r) for r in found] == [(2560, 1000, False, False), (1000, 1, False, False), (1920, 2560, True, False), (1000, 250, False, True), (2560, 2, True, False), (2560, 1, True, False)]


def test_bounds_of_one_image_are_those_of_a_column(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(4)
    sizes = [(rnd.randint(1, 7000), rnd.randint(1, 7000)) for _ in range(500)] + [(1, 1), (2560, 5), (5120, 5)]
    found = spark.createDataFrame(sizes, "w int, h int").select("w", "h", images.resize_bounds(F.col("w"), F.col("h")).alias("b")).select("w", "h", "b.*").collect()
    assert all(tuple(r)[2:] == images.bounded(r.w, r.h) for r in found)


def test_rounding_is_pythons(spark):
    from pyspark.sql import functions as F

    from slipweave.functions.text import rounded

    rnd = random.Random(9)
    values = [0.78125, 0.65875, 2.675, 0.12345, 0.5, 0.99995, 1e-9, -0.00005, 123456.78905, float("nan"), float("inf"), None, 1e300, -2.5e-5]
    values += [k / 128 / n for k in range(64, 512, 7) for n in range(1, 9)] + [rnd.random() for _ in range(2000)]
    for places in (3, 4):
        got = [r.v for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), places).alias("v")).collect()]
        want = [None if v is None else round(v, places) for v in values]
        assert [repr(abs(g)) if g == 0 else repr(g) for g in got] == [repr(abs(w)) if w == 0 else repr(w) for w in want]


def test_backoff():
    assert list(images.backoff(96, 8, 2)) == [(96, 8), (48, 4), (24, 2), (12, 1)]
    assert list(images.backoff(1, 1, 2)) == [(1, 1)]
    assert list(images.backoff(9, 3, 1)) == [(9, 3)] * 4

    class Full:
        memory_errors = (MemoryError,)
        tried, freed = [], 0

        def recognize(self, xs, r, d, math):
            self.tried.append((r, d, math))
            raise MemoryError("full") if len(self.tried) % 2 else recognize.OutOfMemory("full")

        def free_memory(self):
            Full.freed += 1

    with pytest.raises((MemoryError, recognize.OutOfMemory)):
        recognize.with_backoff(Full(), [b""], Settings(math_mode=True))
    assert Full.tried == [(96, 8, True), (48, 4, True), (24, 2, True), (12, 1, True)] and Full.freed == 4

    class Fine:
        def recognize(self, xs, r, d, math):
            return [[] for _ in xs]

    assert recognize.with_backoff(Fine(), [1, 2], Settings(oom_divisor=0)) == [[], []]
    with pytest.raises(ZeroDivisionError):
        recognize.with_backoff(Full(), [1], Settings(oom_divisor=0))


def test_orientation_keeps_the_first_of_equals():
    class One:
        def recognize(self, xs, r, d, math):
            return [[("t", (0, 0, 1, 1), {0: 0.5, 90: 0.5, 180: 0.7, 270: 0.7}[x])] for x in xs]

    on = Settings(orientation_fallback=True)
    assert recognize.upright(One(), 0, lambda x, d: d, on) == (180, 180)
    assert recognize.upright(One(), 0, lambda x, d: d) == (0, 0)
    assert recognize.upright(One(), 0, lambda x, d: d, on, assume_upright=True) == (0, 0)


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# a comment\nSHOP_MAX_BATCH=4\nexport SHOP_ROW_GAP_MULT='2.5'\nSHOP_MATH_MODE=1\nDETECTOR_BATCH_SIZE=3\n")
    s = load({"SHOP_MAX_BATCH": "7", "SHOP_ORIENTATION_FALLBACK": "yes"}, tmp_path / ".env", "SHOP_")
    assert (s.max_images_per_call, s.row_gap_mult, s.math_mode, s.detector_batch, s.orientation_fallback) == (7, 2.5, True, 3, False)
    assert load({"SHOP_MAX_BATCH": "7"}, tmp_path / "none").max_images_per_call == 16
    with pytest.raises(ValueError):
        load({"SLIPWEAVE_MAX_BATCH": "x"}, tmp_path / "none")
