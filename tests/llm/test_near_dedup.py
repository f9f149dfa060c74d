"""The pipeline's near-dedup stage against brute force over all pairs."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline

from sparkweft.llm import near_dedup


def words_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def edited(words, share, rng):
    return [f"new{rng.random()}" if rng.random() < share else w for w in words]


def corpus():
    rng, rows = random.Random(7), []
    for base in range(60):
        words = [f"b{base}v{rng.randint(0, 400)}" for _ in range(rng.randint(60, 600))]
        rows += [" ".join(edited(words, share, rng)) for share in (0, 0.005, 0.01, 0.02, 0.05)]
    hot = [f"h{rng.randint(0, 400)}" for _ in range(300)]
    rows += [" ".join(edited(hot, 0.01, rng)) for _ in range(60)]
    rows += ["a b c", "A  b c", "a b d", "", None, "same words " * 50, "other words " * 50]
    rng.shuffle(rows)
    return list(enumerate(rows))


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]


def test_stage_equals_brute_force(spark):
    rows = corpus()
    sets = [words_set(t) for _, t in rows]
    close = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = groups(len(rows), close)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in near_dedup.near_components(docs).collect()}
    caught = sum(got[a] == got[b] for a, b in close)
    assert len(close) > 300 and caught >= 0.99 * len(close)
    # Nothing is linked that brute force does not link.
    assert all(want[i] == want[c] for i, c in got.items())
    kept = corpus_pipeline.drop_near_texts(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in got.items() if i == c)
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_similar_is_exact():
    for a, b, want in ((range(8), range(10), True), (range(79), range(100), False), (range(80), range(100), True), ([1], [2], False)):
        import numpy as np

        assert near_dedup.similar(np.array(a, np.uint64), np.array(b, np.uint64)) is want


def test_no_link_of_a_large_cell_is_passed_over(spark):
    """150 texts that share cells without being similar, and a close twin of each."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(150):
        one = edited(base, 0.045, rng)
        twin = list(one)
        twin[rng.randint(20, 380)] = f"new{rng.random()}"
        texts += [" ".join(one), " ".join(twin)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    sets = [words_set(t) for t in texts]
    close = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = groups(len(rows), close)
    got = {r.id: r.component_id for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want)) > 50 and [got[i] for i in range(len(rows))] == want


def test_rounds_reach_every_pair_between_groups():
    import numpy as np

    sign = np.zeros((40, near_dedup.VALUES), np.uint8)
    group = np.arange(40) // 10
    pairs, more = near_dedup._across(sign, group, 3)
    assert more and len(pairs) == 3 * 6
    pairs, more = near_dedup._across(sign, group, 100)
    assert not more and {tuple(sorted(p)) for p in pairs} == {(a, b) for a, b in itertools.combinations(range(40), 2) if group[a] != group[b]}
