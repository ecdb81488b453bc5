"""Pages that nest deeply or have very many unlike siblings, and top-k queries that are there several times."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import html_text, mtree

NAMES = ("section", "div", "blockquote", "ul", "p", "b")


def test_deep_and_wide_pages_stand_beside_others(spark):
    """Ten thousand levels of several kinds, unclosed inline elements, and ten thousand siblings of names of their own: every row is there, whole."""
    usual = [(k, "https://h.org/a", f"<html><body><nav><a href=/>home {k % 3}</a></nav><article><p>story {k} " + "word " * 30 + "</p></article></body></html>") for k in range(6)]
    deep = "<body><article>" + "".join(f"<{NAMES[k % 4]} class=c{k % 7}>" for k in range(10_000)) + "deep text" + "".join(f"</{NAMES[k % 4]}>" for k in reversed(range(10_000))) + "<p>after</p></article>"
    wide = "<body><article>" + "".join(f"<div class=w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}>t{k}</div>" for k in range(10_000)) + "</article>"
    wide_too = "<body><article>" + "".join(f"<div class=v{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}>u{k}</div>" for k in range(10_000)) + "</article>"
    bold = "<body><article>" + "<b>" * 5_000 + "<p>x</p>" * 3_000 + "</article>"
    rows = usual + [(100, "https://h.org/b", deep), (101, "https://h.org/c", wide), (102, "https://h.org/d", wide_too), (103, "https://h.org/e", bold), (104, "https://i.org/", deep), (None, None, deep)]
    began = time.time()
    got = {(r["page_id"], r["url"]): r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert time.time() - began < 120 and len(got) == len(rows)
    for k, url, page in usual:
        assert got[k, url] == f"story {k} " + " ".join(["word"] * 30)
    assert got[100, "https://h.org/b"] == got[104, "https://i.org/"] == got[None, None] == "deep text after"
    assert got[101, "https://h.org/c"] == " ".join(f"t{k}" for k in range(10_000)) and got[102, "https://h.org/d"] == " ".join(f"u{k}" for k in range(10_000))
    assert got[103, "https://h.org/e"] == " ".join(["x"] * 3_000)


def test_time_of_depth_and_width_is_near_proportion():
    """Four times the page takes nowhere near sixteen times as long."""

    def seconds(page, n):
        first, other = page(n, "a"), page(n, "b")
        began = time.process_time()
        html_text.infer([first, other])
        return time.process_time() - began

    deep = lambda n, c: "".join(f"<div class={c}>" for _ in range(n)) + "x"
    wide = lambda n, c: "".join(f"<h3 class={c}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}>x</h3>" for k in range(n))
    for page in (deep, wide):
        seconds(page, 500)
        assert seconds(page, 8_000) < 10 * max(seconds(page, 2_000), 0.02)


def neighbours(rows, query_id, vector):
    best = sorted((-int(vector @ v), j) for j, v in rows if j != query_id)[:10]
    return [(query_id, n + 1, j, -s) for n, (s, j) in enumerate(best)]


def test_queries_that_repeat_are_answered_once(spark):
    rng = np.random.default_rng(2)
    table = [(k, rng.normal(size=5).tolist()) for k in range(250)]
    table += [table[100], table[100], (200, rng.normal(size=5).tolist())]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 100 == 0, shard=40, block=2, pivots=5).collect())
    fine = [(i, np.floor(np.array(v) * 1024).astype(np.int64)) for i, v in table]
    want = [x for i, q in {(i, tuple(q)): (i, q) for i, q in fine if i % 100 == 0}.values() for x in neighbours(fine, i, q)]
    assert got == sorted(want) and len(want) == 40  # id 200 has two vectors


def test_pivots_are_sorted_out_of_few_rows(spark):
    """However many pivots are asked for, no task sorts the table: only rows under a bound of the hash reach the window."""
    rows = spark.range(200_000).select("id", F.lit(3).alias("width"), F.array("id", "id", "id").alias("v"))
    for most in (1, 1100):
        chosen = mtree.smallest_hashes(rows, {3: most}, {3: 200_000})
        want = sorted(r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(most).select("id").collect())
        assert sorted(r["v"][0] for r in chosen.collect()) == want and [r["place"] for r in chosen.orderBy("place").collect()] == list(range(1, most + 1))
        plan = chosen._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in plan and "(cast(xxhash64" in plan[plan.index("Window") :].replace("hash#", "(cast(xxhash64")
    assert mtree.smallest_hashes(rows.limit(0), {}, {}).count() == 0
