"""The operators against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import ann, bpe, exact_dedup, language_id, license_scan, line_dedup, lm_scoring, packing, sharding, simhash
from sparkweft.llm.common import id_crc
from sparkweft.llm.components import components

EN = "the quick brown fox jumps over the lazy dog and runs to the river where it was told that nothing is lost"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft zum fluss wo nichts verloren ist und alles bleibt"
ODD = [
    (1, None), (2, ""), (3, "   "), (4, "a"), (5, "A  b\tc"), (6, "a b c"), (7, "a b c"), (7, "a b c"), (8, EN), (9, EN + " again"), (10, DE), (11, DE + "\n" + EN), (12, "line one\nline two\n\nline one\nline two"),
    (13, "x " * 3000), (14, "released under the MIT License. All Rights  reserved, cc-by"), (15, "привет мир " * 5), (16, "!!! 123 ..."), (17, "don't <|endoftext|> 漢字 é́"), (18, "Line one\nline two\nother"), (19, "a b c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Columns that clash with names used inside."""
    rows = [(i, t, "en" if i % 2 else "de", i, i) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, count long, id long")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def test_exact_dedup(spark, odd, empty):
    got = exact_dedup.duplicate_report(odd).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(normal(t), []).append(i)
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.doc_id in groups[key] and r.keep_id == min(groups[key]) and r.group_size == len(groups[key])
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.duplicate_report(empty).count() == 0
    nulls = spark.createDataFrame([(None, "q"), (5, "q"), (None, "r")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in exact_dedup.duplicate_report(nulls).collect()) == [("5", "5", True), ("None", "5", False), ("None", "None", True)]


def brute_lines(rows, modulus=3, long_bytes=200):
    docs = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        own, ended = [], True
        for k, line in enumerate(lines):
            is_long = len(line.encode()) >= long_bytes
            if ended or is_long:
                own.append([])
            own[-1].append(line)
            two, one = (h[k - 2] if k > 1 else 0), (h[k - 1] if k else 0)
            ended = is_long or ((two * 961 + one * 31) % 1000003 + h[k]) % 1000003 % modulus == 0
        docs[i] = own
    seen, out = set(), {}
    for i in sorted(docs):
        left = []
        for c in docs[i]:
            text = "\n".join(c)
            if (len(c) > 1 or len(text.encode()) >= long_bytes) and text in seen:
                continue
            seen.add(text)
            left.append(text)
        out[i] = "\n".join(left)
    return out


def test_line_dedup(spark, odd, empty):
    random.seed(3)
    pool = [f"line number {k} of the pool" for k in range(30)] + ["long " * 60]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(random.randint(1, 40)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:10]] + [(500, None), (501, "Bx\nAy\nB")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    assert {i: r.clean_text for i, r in got.items()} == want
    assert all(r.n_lines == len((dict(rows)[i] or "").split("\n")) for i, r in got.items())
    assert sum(got[i].removed_chunks for i in range(100, 110)) > 10
    again = line_dedup.line_dedup(odd)
    assert again.columns[: len(odd.columns)] == odd.columns and again.count() == len(ODD)
    assert line_dedup.line_dedup(empty).count() == 0


def test_license_scan(spark, odd, empty):
    got = {r.doc_id: r for r in license_scan.license_report(odd).collect()}
    assert got[14].base_labels == "cc-by,reserved" and got[14].labels == "cc-by,mit,reserved" and (got[14].first_word, got[14].last_word, got[14].n_base) == (5, 8, 2)
    assert got[1].n_words == 0 and got[1].first_word is None and got[1].labels == ""
    assert all(r.n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (dict(ODD)[i] or "").translate({c: c + 32 for c in range(65, 91)}))) for i, r in got.items())
    words = license_scan.TEMPLATES["mit"][1].split()
    near = " ".join(words[:8] + ["very"] + words[8:20] + words[21:])
    r = license_scan.license_report(spark.createDataFrame([(1, "intro " + near + " cc by cc by")], "doc_id long, text string")).first()
    assert r.labels == "cc-by,mit" and r.n_base == 2 and r.last_word - r.first_word == 2
    assert license_scan.license_report(empty).count() == 0


def test_fingerprint():
    import xxhash

    for _, t in ODD:
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0
        assert simhash.fingerprint(t or "") == want


def test_simhash_links_are_complete(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:40]:
        for _ in range(6):
            x = int(b)
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    hot = int(base[0])
    fps |= {hot ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(20), 2)}
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4)
    found = {r.node: r.component for r in components(edges).collect()}
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert all(found.get(x, x) == root(x) for x in signed)


def test_simhash_components(odd, empty):
    got = {(r.id, r.component_id) for r in simhash.simhash_components(odd).collect()}
    assert {c for i, c in got if i in (1, 2, 3)} == {1} and {c for i, c in got if i in (5, 6, 7, 19)} == {5}
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {c for _, c in got}
    assert simhash.simhash_components(empty).count() == 0 and simhash.near_dedup(empty).count() == 0


def test_language_id(spark, odd, empty):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.id: r for r in language_id.identify(odd, model).collect()}
    assert got[8].lang_pred == "en" and got[10].lang_pred == "de" and got[10].score > 0.9
    assert [s.lang for s in got[11].spans] == ["de", "en"] and sum(s.words for s in got[11].spans) == len((DE + " " + EN).split())
    for i in (1, 2, 3, 16):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].spans == []
    assert got[15].lang_pred in ("de", "en")
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and {1, 2, 3, 16} == {i for i, _ in ODD} - {r.doc_id for r in kept.collect()}
    assert language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.learn(empty)).collect()} == {"und"}


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 5, 33, 0, 70, 32, 64])
    scores = rng.normal(0, 3, (int(lengths.sum()), 3)).astype(np.float32)
    labels = language_id.viterbi(scores, lengths, 4.0)
    at = 0
    for n in lengths:
        s, own = scores[at : at + n].astype(float), labels[at : at + n]
        at += n
        if not n:
            continue
        best = s[0].copy()
        for row in s[1:]:
            best = np.maximum(best, best.max() - 4.0) + row
        value = s[np.arange(n), own].sum() - 4.0 * (own[1:] != own[:-1]).sum()
        assert value == pytest.approx(best.max(), abs=1e-3)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_equals_the_library(name):
    encoder = bpe.encoder(public_tokenizers.path(name))
    random.seed(7)
    pool = "abc ABC  \n\t\r\x0b\x1c\x85\xa0éÉñ'st <|endoftext|>0123४五漢字かな😀‍ﬁſKİß̈́²½ªº…—‘​ don't WE'LL"
    texts = [t or "" for _, t in ODD] + ["".join(random.choice(pool) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    for text, ids in zip(texts, encoder.encode_batch(texts)):
        want = encoder.library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        if not encoder.folds:
            assert encoder.decode(ids) == encoder.library.decode(want, skip_special_tokens=False)
            assert encoder.shown(ids) == ",".join(map(str, want))


def test_forced_boundaries():
    encoder = bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for token in encoder.token_bytes[:-1]:
        assert len(token) < 2 or not len(encoder.cuts(token))
    assert len(encoder.cuts("漢q字".encode())) > 0


def test_ann_recall(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2001, [0.0] * 24), (2020, [float("nan")] * 24), (2040, [None] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 10, block=600).collect()
    scores = vectors @ vectors.T
    hits, by_query = 0, {}
    for r in got:
        assert r.score == pytest.approx(scores[r.query_id, r.vec_id]) and r.query_id != r.vec_id
        by_query.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, own in by_query.items():
        assert [x[0] for x in sorted(own)] == list(range(1, 11)) and [x[2] for x in sorted(own)] == sorted((x[2] for x in own), reverse=True)
        want = [i for i in np.argsort(-scores[q], kind="stable") if i != q][:10]
        hits += len(set(want) & {x[1] for x in own})
    assert len(by_query) == 75 and hits / 750 >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0, 10)
    assert few.count() == 4 and ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_sharding(spark, odd, empty):
    rng = random.Random(4)
    texts = ["w" * rng.randint(1, 400) + "é" * rng.randint(0, 3) for _ in range(900)]
    rows = [(i, texts[i // 2]) for i in range(1800)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), part=300).collect()
    sizes = np.bincount([r.shard for r in got], [r.size for r in got])
    assert len(sizes) == 8 and sizes.max() / sizes.min() < 1.05
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert all(r.size == len(texts[r.doc_id // 2].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id // 2].encode()) for r in got)
    apart = {}
    for r in got:
        apart.setdefault(texts[r.doc_id // 2], set()).add(r.shard)
    assert all(len(s) == 1 for s in apart.values())
    hot = sharding.shards(spark.createDataFrame([(i, "same text") for i in range(800)], "doc_id long, text string")).collect()
    n = np.bincount([r.shard for r in hot], minlength=8)
    assert n.max() / n.min() < 1.7
    assert sharding.shards(odd).count() == len(ODD) and sharding.shards(empty).count() == 0


def test_packing(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = odd.unionByName(odd.withColumn("text", F.repeat(F.coalesce("text", F.lit("x")), 40)).withColumn("doc_id", F.col("doc_id") + 100))
    got = packing.pack_documents(docs, path, capacity=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 64) + 2
    library = bpe.encoder(path).library
    first = [r for r in got if r.doc_id == 113]
    ids = np.array(library.encode("x " * 3000 * 40, add_special_tokens=False).ids + [1], "<u4")
    assert {(r.piece, r.start, r.length, r.ids_crc32) for r in first} == {(k, k * 64, len(ids[k * 64 : k * 64 + 64]), zlib.crc32(ids[k * 64 : k * 64 + 64].tobytes())) for k in range(-(-len(ids) // 64))}
    assert packing.pack_documents(empty, path).count() == 0


def test_genetic_packing_improves():
    rng = np.random.default_rng(0)
    sizes = np.sort(np.concatenate([(a := rng.integers(20, 60, 150)), (b := rng.integers(10, 40, 150)), 100 - np.minimum(99, a + b)]))[::-1]
    sizes = sizes[sizes > 0]
    greedy = packing.best_fit(sizes, 100, np.arange(len(sizes)))
    elite = packing.evolve([greedy], sizes, 100, 30, 6, rng)[0]
    assert packing.fitness(elite, sizes, 100) >= packing.fitness(greedy, sizes, 100)
    assert np.bincount(elite, sizes).max() <= 100 and len(np.unique(elite)) == elite.max() + 1


def test_packing_islands(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(x)) for i, x in enumerate(rng.integers(26, 50, 700))]
    got = packing.pack(spark.createDataFrame(rows, "row long, length long"), capacity=100, shard=200).collect()
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + dict(rows)[r.row]
    assert len(got) == 700 and max(fill.values()) <= 100


def test_lm_scores(spark, odd, empty):
    rng = random.Random(0)
    en, de = EN.split(), DE.split()
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(60))) for i in range(400)] + [(1000 + i, t) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in lm_scoring.lm_scores(docs, id_crc("doc_id") % 10 == 0).collect()}
    counts = {}
    tokens = {i: (t or "").encode().lower().split() + [b" "] for i, t in rows}
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    for _, t in train:
        for w in (t or "").encode().lower().split() + [b" "]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        want = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert got[i].base_score == pytest.approx(want, rel=1e-9) and got[i].n_tokens == len(own) and got[i].train_tokens == n
        assert got[i].n_known == sum(w in counts for w in own) and got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for i, r in got.items() if r.held_out and i < 400]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scoring.lm_scores(empty, F.lit(False)).count() == 0


def lm_tree(words, counts):
    import xxhash

    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    suffixes = np.array([lm_scoring.suffix(w) for w in words], np.uint16)
    counts = np.array(counts, np.int64)
    known = counts > 0
    tree = lm_scoring.Tree.of(np.concatenate((np.bincount(suffixes[known], counts[known], lm_scoring.SUFFIXES), np.bincount(suffixes[known], minlength=lm_scoring.SUFFIXES))).astype(np.int64))
    cells = tree.cells(hashes[known], suffixes[known])
    tree.finish(np.concatenate((np.bincount(cells, counts[known], lm_scoring.CELLS), np.bincount(cells, minlength=lm_scoring.CELLS))).astype(np.int64))
    return tree, hashes, suffixes, counts


def test_model_is_a_distribution():
    """Over all known words and one unknown the probabilities sum to 1, whatever the weights."""
    rng = np.random.default_rng(0)
    words = sorted({bytes(rng.integers(97, 123, int(rng.integers(1, 7))).astype(np.uint8)) for _ in range(3000)} | {b"the", b" "})
    tree, hashes, suffixes, counts = lm_tree([*words, b"\x00unknown"], [*rng.zipf(1.5, len(words)).clip(1, 10**6), 0])
    model = lm_scoring.Model(tree)
    for scale in (0, 0.5):
        model.weights += rng.normal(0, scale, model.weights.shape).astype(np.float32)
        total = 0.0
        for start in range(0, len(hashes), 500):
            some = np.arange(start, min(start + 500, len(hashes)))
            tokens = np.stack((np.full(len(some), 5), np.full(len(some), 9), some), axis=1).ravel()
            row = {"hashes": hashes.tobytes(), "suffixes": suffixes.tobytes(), "counts": counts.tobytes(), "tokens": lm_scoring.planes(tokens), "lengths": [3] * len(some), "held": [True] * len(some)}
            prefix = row | {"tokens": lm_scoring.planes(np.array([5, 9])), "lengths": [2], "held": [True]}
            whole = lm_scoring.log_by_text(model, lm_scoring.Encoded(tree, row)) - lm_scoring.log_by_text(model, lm_scoring.Encoded(tree, prefix))
            total += np.exp(whole).sum()
        assert total == pytest.approx(1, abs=1e-3)


def lm_docs():
    rng = random.Random(1)
    en, de = EN.split(), DE.split()
    return [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(60))) for i in range(300)] + [(1000 + i, t) for i, t in ODD] + [(None, "no id here"), (None, None)]


def test_lm_scores_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(lm_docs(), "doc_id long, text string")
    one, eight = (sorted(map(tuple, lm_scoring.lm_scores(docs.repartition(n), id_crc("doc_id") % 10 == 0).collect()), key=str) for n in (1, 8))
    assert one == eight


def test_lm_updates_until_nothing_is_gained(spark, monkeypatch):
    """Words that follow each other: training ends where one more update gains next to nothing."""
    rng, words = random.Random(2), [f"w{k}x" for k in range(60)]
    rows = []
    for i in range(300):
        at, text = rng.randrange(60), []
        for _ in range(50):
            text.append(words[at])
            at = (at * 7 + rng.randrange(3)) % 60
        rows.append((i, " ".join(text)))
    gains, move, train = [], lm_scoring.Model.move, lm_scoring.trained

    def watched(blocks, tree):
        moves = []
        monkeypatch.setattr(lm_scoring.Model, "move", lambda self, *a: (moves.append(1), move(self, *a)) and None)
        model = train(blocks, tree)
        assert len(moves) > 2
        seen = lm_scoring.summed(blocks, lm_scoring.observed(spark.sparkContext.broadcast(model))).reshape(-1, lm_scoring.WAYS)
        counts, before = lm_scoring.hoped(blocks, model, seen)
        move(model, seen, counts)
        gains.append((lm_scoring.hoped(blocks, model, seen)[1] - before) / abs(before))
        return model

    monkeypatch.setattr(lm_scoring, "trained", watched)
    assert lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).count() == 300
    assert gains[0] < lm_scoring.TOLERANCE


def test_lm_learns_nothing_from_held_out_texts(spark):
    rows = lm_docs()
    held = next(i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 10 == 0)
    more = [*rows, (held, " ".join(f"new{k}word" for k in range(5000)) + " the fox")]
    before, after = ({(r.id, r.n_tokens): r for r in lm_scoring.lm_scores(spark.createDataFrame(x, "doc_id long, text string"), id_crc("doc_id") % 10 == 0).collect()} for x in (rows, more))
    assert all(after[k] == r for k, r in before.items()) and len(after) == len(before) + 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in ODD] + [(50 + i, EN if i % 2 else DE, "en" if i % 2 else "de", "s", 9) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in docs.collect()}
