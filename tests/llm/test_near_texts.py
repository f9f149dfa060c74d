"""The near-dedup stage gets its candidates from fingerprints under the segment-count grid."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
import numpy as np

from sparkweft.llm import near_texts


def joined(n, links):
    """Each node's smallest reachable one."""
    of = list(range(n))
    for a, b in links:
        a, b = sorted((of[a], of[b]))
        of = [a if x == b else x for x in of]
    return of


def test_linked_sets_against_all_pairs():
    rng = random.Random(3)
    sets = []
    for _ in range(40):
        base = rng.sample(range(1000), rng.randint(1, 60))
        sets += [np.unique(np.array([x for x in base if rng.random() > 0.08] + rng.sample(range(1000, 2000), rng.randint(0, 4)), np.uint64)) for _ in range(5)]
    sets = [s for s in sets if len(s)]
    close = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[a], sets[b])) * 5 >= len(np.union1d(sets[a], sets[b])) * 4]
    links = near_texts.linked_sets(sets)
    assert len(close) > 60 and set(map(tuple, map(sorted, links))) <= set(close) and len(links) < len(sets)
    assert joined(len(sets), links) == joined(len(sets), close)


def test_candidates_connect_all_within_the_radius(spark):
    """One fingerprint within the radius is enough; a crowd in one cell gives no pairs without end."""
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        base = rng.getrandbits(64)
        for bits in (0, 1, 3, 4, 5, 6):
            own = [rng.getrandbits(64) for _ in range(near_texts.PRINTS)]
            own[rng.randrange(near_texts.PRINTS) if bits == 6 else 2] = base ^ sum(1 << k for k in rng.sample(range(64), bits))
            rows.append(own)
    crowd = rng.getrandbits(64)
    rows += [[crowd ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))] * near_texts.PRINTS for _ in range(300)]
    close = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if any((x ^ y).bit_count() <= 4 for x, y in zip(rows[a], rows[b]))]
    signed = [(i, [x - (1 << 64) if x >> 63 else x for x in own]) for i, own in enumerate(rows)]
    found = [(r.u, r.v) for r in near_texts.candidates(spark.createDataFrame(signed, "key long, prints array<long>")).collect()]
    assert set((b, a) for a, b in found) <= set(close) and joined(len(rows), found) == joined(len(rows), close)
    assert len(found) < len(close) / 2


def test_stage_takes_its_candidates_from_the_grid(spark, monkeypatch):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:120], "new", *words[121:]])), (3, "another text"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_texts(spark, docs, "").collect()) == [1, 3, 4]
    monkeypatch.setattr(near_texts, "candidates", lambda sets: spark.createDataFrame([], "u long, v long"))
    monkeypatch.setattr(near_texts, "discard", lambda *tables: None)
    assert corpus_pipeline.drop_near_texts(spark, docs, "").count() == 4
