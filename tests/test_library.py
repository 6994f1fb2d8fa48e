import random

import numpy as np
import pytest

from biblion.operators import graph as G
from biblion.operators import ingest as I
from biblion.operators import library as L
from biblion.operators import retrieval as R
from biblion.operators.wiki import markdown_html
from biblion.streaming import jobs as J


def test_first_of_run_is_greedy(spark):
    rng = random.Random(5)
    rows = [(f"r{i % 3}", i, f"u{i}", rng.choice([None, "10.5/a", "10.5/b", "10.5/c", "10.5/d"]), rng.choice([None, "one", "two", "three", "four", "five"])) for i in range(90)]
    got = {r.uid: r.status for r in I.first_of_run(spark.createDataFrame(rows, "run string, seq long, uid string, doi string, title string"), run="run").collect()}
    want, seen = {}, {}
    for run, _, uid, doi, title in rows:
        keys = {(run, "d", doi), (run, "t", title)} - {(run, "d", None), (run, "t", None)}
        fresh = not any(k in seen for k in keys)
        want[uid] = "deduped" if fresh else "skipped_cross_source"
        seen.update(dict.fromkeys(keys if fresh else ()))
    assert got == want
    assert I.first_of_run(spark.createDataFrame([], "run string, seq long, uid string, doi string, title string"), run="run").count() == 0


def test_graph_view_replays_the_rule(spark):
    rng = random.Random(6)
    edges = [(rng.randint(1, 30), rng.randint(1, 30), "uses", float(rng.randint(1, 4))) for _ in range(80)]
    edges = list({e[:3]: e for e in edges}.values())
    e = spark.createDataFrame(edges, "src long, tgt long, rel_type string, weight double")
    n = spark.createDataFrame([(i, f"name {i:02d}", "CONCEPT", i) for i in range(1, 41)], "id long, name string, kind string, mention_count int")
    ids, taken = G.graph_view(n, e, limit=12)
    order = sorted(edges, key=lambda x: (-x[3], x[0], x[1], x[2]))
    chosen, keep = set(), set()
    for s, t, r, _ in order[:200]:
        new = {s, t} - chosen
        if len(chosen) + len(new) <= 12:
            chosen |= new
            keep.add((s, t, r))
    assert {(r.src, r.tgt, r.rel_type) for r in taken.collect()} == keep
    got = {r.id for r in ids.collect()}
    assert chosen <= got and len(got) == 12
    assert {r.id for r in G.graph_view(n, e, limit=12, min_degree=1)[0].collect()} == chosen


def test_nearest_vectors_are_exact(spark):
    rng = np.random.default_rng(7)
    m = rng.standard_normal((50, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(90, []), (91, [0.0] * 8), (92, [1.0, 2.0]), (93, None)]
    v = spark.createDataFrame(rows, "id long, e array<double>")
    q = spark.createDataFrame([(1, rows[3][1]), (2, rows[7][1]), (3, None), (4, [0.0] * 8)], "query_id int, query_vector array<double>")
    for block in (2000, 1):
        got = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in R.knn(v, q, "id", "e", 5, block).collect()}
        for k, i in ((1, 3), (2, 7)):
            sim = np.round(m @ m[i] / (np.linalg.norm(m, axis=1) * np.linalg.norm(m[i])), 6)
            best = sorted(range(50), key=lambda x: (-sim[x], x))[:5]
            assert [got[k, j + 1][0] for j in range(5)] == best
        assert got[4, 1] == (0, 0.0) and not any(k == 3 for k, _ in got)
    assert R.knn(v, q.limit(0), "id", "e").count() == 0 and R.knn(v.limit(0), q, "id", "e").count() == 0


def test_new_ids_count_on(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(500)], "k string")
    got = {r.k: r.no for r in L.with_new_ids(df, "no", "k").collect()}
    assert got == {f"k{i:03d}": i + 1 for i in range(500)}


def test_chunk_progress_starts_anew(spark):
    marks = [("a", 1, 3, 0), ("a", 2, 3, 1), ("a", 3, 2, 0), ("a", 4, 2, 0), ("b", 5, 2, 0), ("b", 6, 2, 1)]
    got = {r.article_uid: (r.n_chunks, r.done, r.through) for r in J.chunk_progress(spark.createDataFrame(marks, "article_uid string, seq long, n_chunks int, chunk int")).collect()}
    assert got == {"a": (2, 1, False), "b": (2, 2, True)}


def test_markdown():
    assert markdown_html("# A <b>\n\nOne\ntwo **three** `x<y`\n\n- a\n- [b](c.md)\n\n1. n\n\n> q\n\n```\n<raw> **no**\n```") == (
        "<h1>A &lt;b&gt;</h1>\n<p>One two <strong>three</strong> <code>x&lt;y</code></p>\n<ul><li>a</li><li><a href=\"c.md\">b</a></li></ul>\n<ol><li>n</li></ol>\n"
        "<blockquote>q</blockquote>\n<pre><code>&lt;raw&gt; **no**</code></pre>"
    )
    assert markdown_html("[x](javascript:alert)") == "<p>[x](javascript:alert)</p>" and markdown_html("") == ""


def test_force_layout_is_bounded_and_repeats(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 5.0), (3, 1, None), (4, 5, 1000.0), (6, 6, 1.0)], "src long, tgt long, weight double")
    a, b = (sorted(map(tuple, G.force_layout(nodes, edges).collect())) for _ in range(2))
    assert a == b and len(a) == 6 and max(abs(v) for r in a for v in r[1:]) == pytest.approx(0.96)
    assert G.force_layout(nodes.limit(0), edges).count() == 0


def test_late_rows_follow_the_watermark(spark):
    rows = [(0, "2024-01-01 00:00:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-01 03:59:59"), (3, "2024-01-01 04:00:00"), (4, "2024-01-01 06:00:00")]
    df = spark.createDataFrame(rows, "seq long, ts string").selectExpr("seq", "cast(ts as timestamp) ts")
    assert {r.batch: (r.n, r.n_late) for r in J.late_rows(df, 2, 3600).collect()} == {0: (2, 0), 1: (2, 1), 2: (1, 0)}
