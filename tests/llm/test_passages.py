"""Passages of short lines, planted between unlike neighbours."""

from __future__ import annotations

import random

import pytest

from sparkweft.llm import passage_dedup


def brute(rows, words=50):
    """Clean texts by the definition; ids are unique."""
    places, first, gone = [], {}, set()
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        real = [k for k, line in enumerate(lines) if line.split()]
        for a, k in enumerate(real):
            n = 0
            for b in range(a, len(real)):
                n += len(lines[real[b]].split())
                if n > words:
                    places.append((tuple(lines[x] for x in real[a : b + 1]), i, k, real[b]))
                    break
    for key, i, k, last in places:
        j, _, end = first.setdefault(key, (i, k, last))
        if i != j or k > end:
            gone |= {(i, x) for x in range(k, last + 1)}
    return {i: "\n".join(line for k, line in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in rows}


def passage(tag, lines, words=51):
    all_words = [f"{tag}w{k}" for k in range(words)]
    cut = [round(k * words / lines) for k in range(lines + 1)]
    return [" ".join(all_words[a:b]) for a, b in zip(cut, cut[1:])]


@pytest.mark.parametrize("lines", range(2, 9))
def test_planted_passages_go_whole(spark, lines):
    rows, at = [], 0
    for trial in range(20):
        shared = passage(f"p{trial}", lines)
        assert all(len(line.encode()) < 200 for line in shared) or lines == 2
        for _ in range(2):
            near = [f"neighbour {at} {k} of its own" for k in range(trial % 5 + 1)]
            rows.append((at, "\n".join(near + shared + [f"end {at}"])))
            at += 1
    got = {r.doc_id: r for r in passage_dedup.passage_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(0, at, 2):
        assert got[k].clean_text == rows[k][1] and got[k].removed_lines == 0
        assert got[k + 1].removed_passages == 1 and got[k + 1].removed_lines == lines
        assert "p" + str(k // 2) + "w" not in got[k + 1].clean_text and got[k + 1].clean_text.endswith(f"end {k + 1}")


def test_equals_brute_force(spark):
    random.seed(5)
    pool = [" ".join(f"v{k}x{j}" for j in range(random.randint(1, 25))) for k in range(12)] + ["", "  ", "long " * 60]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(random.randint(1, 30)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:10]] + [(500, None), (501, ""), (502, "same line of six words here\n" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = passage_dedup.passage_dedup(docs).collect()
    assert {r.doc_id: r.clean_text for r in got} == brute(rows) and len(got) == len(rows)
    assert sum(r.removed_lines for r in got) > 50
    twice = passage_dedup.passage_dedup(docs.unionByName(docs)).collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, got + got))
    assert passage_dedup.passage_dedup(docs.limit(0)).count() == 0
