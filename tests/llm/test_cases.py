"""Defined results of odd rows, and the registered queries themselves."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import ann, digests, exact_dedup, language_id, license_scan, line_dedup, near_dedup, packing, sharding, simhash

A = "one two three four five six seven eight nine ten eleven twelve"
B = "red orange yellow green blue indigo violet black white grey brown pink"


@pytest.mark.parametrize("dedup", [exact_dedup.exact_dedup, near_dedup.near_dedup, simhash.near_dedup])
def test_dedup_decides_by_row(spark, dedup):
    """No group is lost where ids repeat or are null: one row of each stays."""
    docs = spark.createDataFrame([(3, A), (5, B), (5, A), (9, B), (None, A), (None, "quite another text of some words"), (None, "quite another text of some words"), (3, A)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in dedup(docs).collect()), key=str) == sorted([(3, A), (5, B), (None, "quite another text of some words")], key=str)


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = "cc by general public license all rights reserved CC-BY ALL Éé İ x 7 nc".split()
    texts = [" ".join(rng.choice(pool, int(rng.integers(0, 40)))) for _ in range(300)] + [None, "", "cc by cc by cc by", "all all rights reserved reserved"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, score int")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.license_report(docs).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def test_license_labels_count_distinct_places_in_order(spark):
    mit = license_scan.TEMPLATES["mit"][1]
    texts = ["cc by cc by cc by cc by", "by nc x by nc x by nc x by nc", "licensed under cc by nc 4 0", " ".join(reversed(mit.split())), mit, "x " * 50 + mit.replace(" free ", " quite free ") + " y" * 50]
    got = [r.labels for r in license_scan.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["cc-by", "", "cc-by,cc-by-nc", "", "mit", "mit"]


def test_in_order_is_the_longest_run():
    rng = np.random.default_rng(0)
    for _ in range(200):
        votes = [(int(p), int(q)) for p, q in zip(np.sort(rng.choice(40, 8, replace=False)), rng.integers(0, 6, 8))]
        best = 0
        for mask in range(1, 256):
            some = [v for k, v in enumerate(votes) if mask >> k & 1]
            if some[-1][0] - some[0][0] <= 12 and all(a[1] < b[1] for a, b in zip(some, some[1:])):
                best = max(best, len(some))
        assert license_scan.in_order(votes, 12)[0] == best


def test_best_of_overlapping_spans():
    rng = np.random.default_rng(1)
    for _ in range(200):
        spans = [("x", int(a), int(a + n), 1, float(c)) for a, n, c in zip(rng.integers(0, 40, 10), rng.integers(1, 9, 10), rng.integers(1, 4, 10))]
        want, left = [], sorted(spans, key=lambda x: -x[4])
        for span in left:
            if not any(o[4] > span[4] and o[1] < span[2] and span[1] < o[2] for o in want):
                want.append(span)
        assert sorted(license_scan.best_of(spans)) == sorted(want)


def test_sharding_reaches_the_target(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), "w" * int(n), 1, "s") for i, n in enumerate(rng.integers(1, 500, 2000))] + [(None, None, 1, "s")]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, size int, shard string"), target_bytes=3000).collect()
    shard = np.array([r.shard for r in got])
    weight = np.bincount(shard, [r.size for r in got])
    assert len(got) == 2001 and len(weight) > 120 and weight.max() <= 3000 * sharding.SLACK and weight.min() > 0
    for k in np.unique(shard):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(int((shard == k).sum())))


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 3), 1.0]) for i in range(60)] + [(100, [1.0, 2.0]), (120, [9.0] * 5), (140, [])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5, run=2).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and not {100, 120, 140} & {r.vec_id for r in got} and len(got) == 15


def test_letters_of_all_planes(spark):
    far = chr(0x32001) if chr(0x32001).isalpha() else chr(0x31400)
    docs = spark.createDataFrame([(1, far * 5, "zh"), (2, A, "en")], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert {r.id: r.lang_pred for r in language_id.identify(docs, model).collect()} == {1: "zh", 2: "en"}


def test_packing_numbers_of_sequences(spark):
    """Levels end at the lower bound: nothing is lost, no sequence is over capacity."""
    rng = np.random.default_rng(2)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 101, 3000))]
    got = packing.pack(spark.createDataFrame(rows, "row long, length long"), capacity=100, shard=250).collect()
    fill, lengths = {}, dict(rows)
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, lengths[r.row]))
    assert sorted(r.row for r in got) == list(range(3000))
    for own in fill.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 100
    assert len(fill) <= 1.03 * -(-sum(lengths.values()) // 100)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a\nb", 7, "q", 0.5)], "doc_id long, text string, n_lines int, clean_text string, slot double")
    assert line_dedup.line_dedup(docs).first().n_lines == 2
    assert sharding.shards(docs).first().slot == 0


SCHEMAS = {
    "op1_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A null id, repeated rows, an empty text, a null one and one of over a million characters."""
    path = tmp_path_factory.mktemp("tables")
    long = " ".join(f"word{k % 977} {A}" for k in range(18_000))
    rows = [(1, A, "en", "s", 0), (2, B, None, "s", 0), (2, B, None, "s", 0), (3, None, "en", "s", 0), (4, "", "de", None, 0), (None, A, "en", "s", 0), (5, long, "en", "s", None), (20, "漢字 <|endoftext|>\t" + B, "zh", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    vectors = [(i, [float((i * 7 + k) % 11) for k in range(8)], 0) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_registered_query(spark, folder, name):
    got = digests.QUERIES[name](spark, folder)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema.fields) == SCHEMAS[name]
    rows = got.collect()
    if name == "op6_ann":
        assert len(rows) == 60
        return
    ids = [r.doc_id for r in rows if name != "op9_packing" or r.piece == 0]
    assert sorted(ids, key=str) == sorted([1, 2, 2, 3, 4, None, 5, 20], key=str)
    by = {r.doc_id: r for r in rows}
    if name == "op1_lm_scoring":
        assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows) and by[3].n_tokens == 1
    if name == "op4_simhash":
        assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows) and by[3].fingerprint == "0" * 16 and by[4].component_id == 3
    if name == "op5_language_id":
        assert by[3].lang_pred == by[4].lang_pred == "und" and by[3].score == 0
    if name == "op7_sharding":
        assert by[3].size == 1 and by[20].text_crc32 == zlib.crc32(("漢字 <|endoftext|>\t" + B).encode())
    if name == "op8_exact_dedup":
        assert sum(r.kept for r in rows) == 5 and by[4].keep_id == 3 and by[2].group_size == 2
    if name == "op9_packing":
        from sparkweft.llm import bpe
        import public_tokenizers

        library = bpe.encoder(public_tokenizers.path("word_bpe_49k.json")).library
        for doc, text in ((1, A), (3, ""), (20, "漢字 <|endoftext|>\t" + B)):
            ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
            assert (by[doc].length, by[doc].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
