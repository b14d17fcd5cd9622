"""Selection of regions by smoothed ratios, frames, and pages that are nested very deep."""

import math
import time
import tracemalloc

import numpy as np
import pytest

from slipweave.llm import html

SF = "/root/testdata/sf0.01"
TEXT = "A paragraph that is long enough to be the content of this page, whatever else stands here."
MENU = "<ul>" + "".join(f"<li><a href={i}><span>m{i}</span></a></li>" for i in range(9)) + "</ul>"


def plain(ratio, removed, sigma=1.0, low=0.25):
    """The two thresholds said again, line by line."""
    own = [0.0 if r else x for x, r in zip(ratio, removed)]
    weight = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(4)]
    smoothed = []
    for i in range(len(own)):
        near = [(weight[abs(i - j)], own[j]) for j in range(max(0, i - 3), min(len(own), i + 4))]
        smoothed.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    mean = sum(smoothed) / len(smoothed)
    limit = min(math.sqrt(sum((x - mean) ** 2 for x in smoothed) / len(smoothed)), smoothed[own.index(max(own))], max(own))
    seeds = [not r and x >= limit and s >= limit for x, s, r in zip(own, smoothed, removed)]
    runs, i = [], 0
    while i < len(own):
        j = i
        while j < len(own) and smoothed[j] >= low * limit:
            j += 1
        if any(seeds[i:j]):
            runs.append((i, j))
        i = max(j, i + 1)
    return seeds, runs


def test_regions_are_those_of_the_plain_statement():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        n = int(rnd.integers(1, 40))
        ratio = np.where(rnd.random(n) < 0.5, rnd.gamma(2, 2, n), rnd.random(n) * 0.3)
        removed = rnd.random(n) < rnd.choice([0.0, 0.2, 0.6])
        if removed.all():
            continue
        seeds, runs = html.regions(ratio, removed)
        want = plain(ratio.tolist(), removed.tolist())
        assert (seeds.tolist(), runs) == want or np.isclose(ratio, 0).any()


def test_the_ratios_select(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    want = [html.extract(p) for p in pages]
    rnd = np.random.default_rng(1)
    monkeypatch.setattr(html, "smooth", lambda values, sigma: rnd.random(len(values)))
    assert sum(html.extract(p) != w for p, w in zip(pages, want)) > len(pages) // 5


def test_article_tags_do_not_matter(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for tag in ("div", "section", "div class=content"):
        assert all(html.extract(p.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")) == html.extract(p) for p in pages)


@pytest.mark.parametrize("frame", ["form action=x", "div class='layout-sidebar'", "div id=main-header", "fieldset"])
def test_a_frame_around_the_page_is_looked_through(frame):
    inner = f"<nav>{MENU}</nav><h1>Title</h1><p>{TEXT}</p><form>Mail <input></form><div class=sidebar>more</div><p>{TEXT}</p><footer>end</footer>"
    assert html.extract(f"<html><body><{frame}>{inner}</{frame.split()[0]}></body></html>") == f"Title\n{TEXT}\n{TEXT}"


def test_unmarked_menus_go_and_lists_of_the_text_stay():
    items = "".join(f"<li>item number {k}</li>" for k in range(12))
    page = f"<html><body>{MENU}<div><h2>One</h2><p>{TEXT}</p><p>{TEXT * 9}</p><ul>{items}</ul></div>{MENU}</body></html>"
    assert html.extract(page).split("\n") == ["One", TEXT, TEXT * 9, *[f"item number {k}" for k in range(12)]]


@pytest.mark.parametrize("page", ["<div>x" * 17_000, "<div>" * 20_000, "<p>" + "</b></x></div>" * 8_000, "<form>a<div>" * 8_000, "<li>y" * 20_000, "<form><p>z</form>" * 6_000])
def test_a_hundred_kilobytes_of_unclosed_tags(page):
    tracemalloc.start()
    began = time.perf_counter()
    html.extract(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000 and time.perf_counter() - began < 20
