import random

import pytest

from biblion.llm.mixing import cut_time, mix_sources
from biblion.llm.packing import best_fit_runs, pack_documents, packing_report
from biblion.llm.tokens import token_count, with_token_counts

TOKENS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def brute_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_best_fit_on_single_documents(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 64])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 200))]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    load, seen = {}, {}
    for p in best_fit_runs(histogram, capacity):
        for i in range(p.n):
            b = p.container + i // p.per
            load[b] = load.get(b, 0) + p.size
        seen[p.size] = seen.get(p.size, 0) + p.n
    assert seen == histogram and max(load.values()) <= capacity
    assert sorted(capacity - x for x in load.values()) == brute_best_fit(sizes, capacity)


def _docs(spark):
    rows = [(i, "word " * (i % 40 + 1), "a" if i % 3 else "b") for i in range(300)] + [(1000, "long text " * 900, "a"), (1001, None, "a"), (1002, "", "b"), (7, "copy of an id", None)]
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, n_tokens int")


def test_pack(spark):
    docs = _docs(spark)
    kinds = spark.createDataFrame([("s", 64), ("l", 500), ("none", None), ("bad", 0)], "container_kind string, capacity_tokens int")
    rows = pack_documents(docs, kinds, TOKENS).collect()
    sizes = {(r.doc_id, r.n_tokens) for r in with_token_counts(docs.drop("n_tokens"), ["doc_id"], tokenizer=TOKENS).collect()}
    for kind, cap in (("s", 64), ("l", 500)):
        mine = [r for r in rows if r.container_kind == kind]
        bins = {}
        for r in mine:
            bins.setdefault(r.container_id, []).append(r)
        for b in bins.values():
            b.sort(key=lambda r: r.container_offset)
            assert sum(r.n_tokens for r in b) <= cap
            assert all(p.container_offset + p.n_tokens == q.container_offset for p, q in zip(b, b[1:]))
        assert sum(r.n_tokens for r in mine) == sum(n for _, n in sizes)
        assert all(r.piece_no == 0 for r in mine if (r.doc_id, r.n_tokens) in sizes)
        assert sorted(bins) == list(range(len(bins)))
    report = {r.container_kind: r for r in packing_report(pack_documents(docs, kinds, TOKENS), kinds).collect()}
    assert report["s"].fill > 0.95
    assert pack_documents(docs.limit(0), kinds, TOKENS).count() == 0 and pack_documents(docs, kinds.limit(0), TOKENS).count() == 0


def test_token_blocks_add_up():
    text = "The quick brown fox, it jumps. " * 50
    assert token_count(text, TOKENS, block=100) == token_count(text, TOKENS) and token_count(None, TOKENS) == 0


def test_mix(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("gone", 0.2, 2)], "source string, target_share double, max_repeats int")
    docs = _docs(spark).drop("n_tokens").where("doc_id < 1000")
    mix, report = mix_sources(docs, targets, tokenizer=TOKENS)
    rep = {r.source: r for r in report.collect()}
    assert rep["gone"].tokens_taken == 0 and abs(rep["a"].actual_share - 0.625) < 0.02 and abs(rep["b"].actual_share - 0.375) < 0.02
    rows = mix.collect()
    assert max(r["copy"] for r in rows if r.source == "b") < 3 and max(r["copy"] for r in rows if r.source == "a") == 0
    assert len({(r.source, r.doc_id, r["copy"], r.finish_time) for r in rows}) == len(rows)
    small, _ = mix_sources(docs, targets, budget=500, tokenizer=TOKENS)
    assert 350 <= sum(r.n_tokens for r in small.collect()) <= 500
    assert mix_sources(docs.limit(0), targets, tokenizer=TOKENS)[0].count() == 0


def test_cut_time():
    assert cut_time([(0.5, 100), (0.5, 300)], None) == 200 and cut_time([], None) == 0
    assert cut_time([(0.5, 100), (0.5, 300)], 300) == 400 and cut_time([(0.5, 100), (0.5, 300)], 10_000) == 600
