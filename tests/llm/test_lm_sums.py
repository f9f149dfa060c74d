"""The language model's sums: whole, whatever is put together, and small in memory."""

from __future__ import annotations

import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sparkweft.llm import lm_scoring


def block(n_texts=60):
    """A tree of 3,000 words, and a block of texts in which some word pairs recur often."""
    rng = np.random.default_rng(0)
    words = sorted({bytes(rng.integers(97, 123, 6).astype(np.uint8)) for _ in range(3000)} | {b" "})
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    order = np.argsort(hashes)
    hashes, suffixes = hashes[order], np.array([lm_scoring.suffix(w) for w in words], np.uint16)[order]
    counts = rng.zipf(1.5, len(words)).clip(1, 10**5)
    tree = lm_scoring.Tree.of(np.concatenate((np.bincount(suffixes, counts, lm_scoring.SUFFIXES), np.bincount(suffixes, minlength=lm_scoring.SUFFIXES))).astype(np.int64))
    tree.finish(lm_scoring.cell_sums(tree)(pa.RecordBatch.from_pydict({n: pa.array([x.tobytes()], pa.binary()) for n, x in (("hashes", hashes), ("suffixes", suffixes), ("counts", counts))})))
    texts = [rng.integers(0, len(words) if i % 2 else 3, 40) for i in range(n_texts)]
    row = {"hashes": hashes.tobytes(), "suffixes": suffixes.tobytes(), "counts": counts.tobytes(), "tokens": lm_scoring.planes(np.concatenate(texts)), "lengths": [40] * n_texts, "held": [i % 5 == 0 for i in range(n_texts)]}
    kinds = {"lengths": pa.list_(pa.int64()), "held": pa.list_(pa.bool_())}
    return tree, row, pa.RecordBatch.from_pydict({n: pa.array([v], kinds.get(n, pa.binary())) for n, v in row.items()})


def by_token(model, row):
    """Observed and expected counts, token by token."""
    e = lm_scoring.Encoded(model.tree, row)
    seen, hoped, log = Counter(), Counter(), 0
    for i in np.flatnonzero(np.repeat(~np.array(row["held"]), row["lengths"])):
        for k in range(e.depth[i]):
            down = e.cell[i : i + 1] >> np.uint32(2 * (model.tree.levels - 1 - k))
            at, way = down >> np.uint32(2), int(down[0]) % 4
            rows = model.hit(k, at, [x[i : i + 1] for x in (e.last_class, e.skip_class, e.word, e.pair)])
            z = np.exp(model.logits(k, at, rows))
            of = lm_scoring.over_ways(z)
            log += int(np.rint(np.log(of) * lm_scoring.UNIT)[0])
            for r in rows:
                seen[model.levels[k][0] + int(r[0]), way] += 1
                for w in range(3):
                    hoped[w, model.levels[k][0] + int(r[0])] += int(np.rint(z[0, w] * (lm_scoring.UNIT / of))[0])
    return seen, hoped, log


@pytest.mark.parametrize(("at_once", "bits"), [((1 << 18) - 1, 64), (7, 64), (7, 0)])
def test_sums_are_those_of_all_tokens(monkeypatch, at_once, bits):
    tree, row, batch = block()
    monkeypatch.setattr(lm_scoring, "AT_ONCE", at_once)
    monkeypatch.setattr(lm_scoring, "KEY_BITS", bits)
    model = lm_scoring.Model(tree)
    model.weights += np.random.default_rng(1).normal(0, 0.3, model.weights.shape).astype(np.float32)
    seen, hoped, log = by_token(model, row)
    events = lm_scoring.Events(tree, row)
    assert events.times.sum() == 48 * 40 and events.times.max() <= at_once
    assert len(events.times) < 48 * 40 * 0.7
    got = lm_scoring.observed(SimpleNamespace(value=model))(batch).reshape(-1, lm_scoring.WAYS)
    assert {(int(r), int(w)): int(got[r, w]) for r, w in zip(*got.nonzero())} == seen
    got = lm_scoring.expected(SimpleNamespace(value=tree), SimpleNamespace(value=model.weights))(batch)
    sums = got[:-1].reshape(lm_scoring.WAYS - 1, -1)
    assert {(int(w), int(r)): int(sums[w, r]) for w, r in zip(*sums.nonzero())} == +hoped
    assert got[-1] == log


def test_sums_are_added_a_row_at_a_time():
    """40 tasks' rows: memory holds two or three arrays, not all of them."""
    data = lm_scoring.packed(np.random.default_rng(0).integers(0, 1 << 40, 1 << 17))

    def rows():
        for task in range(40):
            yield pa.RecordBatch.from_pydict({"task": pa.array([0], pa.int32()), "part": pa.array([task % 2], pa.int32()), "sums": pa.array([data], pa.binary())})

    before = pa.total_allocated_bytes()
    tracemalloc.start()
    got = [(r.column("part")[0].as_py(), lm_scoring.unpacked(r.column("sums")[0].as_py())) for r in lm_scoring._add(rows())]
    peak = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert [part for part, _ in got] == [0, 1] and all((x == 20 * lm_scoring.unpacked(data)).all() for _, x in got)
    assert peak < 12 * (8 << 17) < 40 * len(data)


def test_what_is_sent_for_a_pass_is_no_more_than_weights():
    import pickle

    model = lm_scoring.Model(block()[0])
    assert len(pickle.dumps(model)) < len(pickle.dumps(model.tree)) + 1000
    model.weights[0] = 1
    assert (pickle.loads(pickle.dumps(model)).weights == model.weights).all()


def test_a_task_sends_sums_in_rows_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PIECE", 100)
    rows = []
    real = lm_scoring.added
    monkeypatch.setattr(lm_scoring, "added", lambda found, tasks: rows.extend(found.collect()) or real(found, tasks))
    got = lm_scoring.summed(spark.range(40).repartition(5), lambda batch, total: np.full(450, batch.num_rows, np.int64) + (0 if total is None else total))
    assert (got == 40).all() and len(got) == 450
    assert len(rows) == 25 and max(len(lm_scoring.unpacked(r.sums)) for r in rows) == 100
