"""The language model's tree: every level sees the context, and words have cells of their own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from sparkweft.llm import lm_scoring


def made(words, counts):
    """The tree, the words' hashes and suffixes, their counts and their cells."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    suffixes = np.array([lm_scoring.suffix(w) for w in words], np.uint16)
    counts = np.array(counts, np.int64)
    tree = lm_scoring.Tree.of(np.concatenate((np.bincount(suffixes, counts, lm_scoring.SUFFIXES), np.bincount(suffixes, minlength=lm_scoring.SUFFIXES))).astype(np.int64))
    batch = pa.RecordBatch.from_pydict({n: pa.array([x.tobytes()], pa.binary()) for n, x in (("hashes", hashes), ("suffixes", suffixes), ("counts", counts))})
    tree.finish(lm_scoring.cell_sums(tree)(batch))
    return tree, hashes, suffixes, counts, tree.cells(hashes, suffixes)


def scored(model, hashes, suffixes, counts, texts):
    texts = np.array(texts)
    row = {"hashes": hashes.tobytes(), "suffixes": suffixes.tobytes(), "counts": counts.tobytes(), "tokens": lm_scoring.planes(texts.ravel()), "lengths": [texts.shape[1]] * len(texts), "held": [True] * len(texts)}
    return lm_scoring.log_by_text(model, lm_scoring.Encoded(model.tree, row))


def random_words(n):
    rng = np.random.default_rng(0)
    return sorted({bytes(rng.integers(97, 123, 6).astype(np.uint8)) for _ in range(n)} | {b" "})


def test_every_level_sees_the_last_word_and_the_last_two():
    """Of two words whose ways part at any one level, which is likelier depends on the context."""
    words = random_words(3000)
    tree, hashes, suffixes, counts, cells = made(words, np.random.default_rng(1).zipf(1.5, len(words)).clip(1, 10**5))
    model = lm_scoring.Model(tree)
    model.weights += np.random.default_rng(2).normal(0, 1, model.weights.shape).astype(np.float32)
    order = np.argsort(cells, kind="stable")
    apart = cells[order][1:] ^ cells[order][:-1]
    levels = int(np.log(len(tree.depth)) / np.log(lm_scoring.WAYS) + 0.5)
    for level in range(levels):
        k = int(np.flatnonzero((apart >> 2 * (levels - 1 - level) > 0) & (apart >> 2 * (levels - level) == 0))[0])
        a, b = order[k], order[k + 1]
        # The words before them have the class of either: only n-grams tell the contexts apart.
        upper = cells >> 2 * (levels - lm_scoring.UPPER)
        ids, first, n = np.unique(upper, return_index=True, return_counts=True)
        x, y = np.flatnonzero(upper == ids[n.argmax()])[:2]
        for one, other in (([x, x], [x, y]), ([x, x], [y, x])):
            of = [scored(model, hashes, suffixes, counts, [[*c, a], [*c, b]]) for c in (one, other)]
            gap = (of[0][0] - of[0][1]) - (of[1][0] - of[1][1])
            assert abs(gap) > 1e-4, level


def test_cells_grow_with_the_words():
    words = random_words(60_000)
    tree, hashes, suffixes, counts, cells = made(words, [1] * (len(words) - 1) + [50])
    assert len(np.unique(cells)) > 0.8 * len(words)
    assert tree.levels == 9 and len(tree.depth) == lm_scoring.WAYS**9
    model = lm_scoring.Model(tree)
    model.weights += np.random.default_rng(2).normal(0, 0.3, model.weights.shape).astype(np.float32)
    texts = np.stack((np.full(len(words), 5), np.full(len(words), 9), np.arange(len(words))), axis=1)
    known = scored(model, hashes, suffixes, counts, texts) - scored(model, hashes, suffixes, counts, [[5, 9]])
    # All that is missing is the mass of unknown words.
    assert abs(np.exp(known).sum() - 1) < 1e-3
