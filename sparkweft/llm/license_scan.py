"""License scans by diagonal voting.

Every two neighbouring words of a text form a hash that is joined to the places
of the same two words in templates: all of them vote. A hit votes for the diagonal
`place in the text - place in the template`; votes are counted by diagonal, diagonals
that lie side by side (a word more, a word less) are merged, and the spans are
verified against the text: both words of each vote are compared, and a template
counts only where enough of its distinct places were hit one after the other, in the
template's order, within a window of SPREAD times its length; of spans that overlap
those of the greatest coverage stay.

Hashes that no template holds are dropped inside the scan of the texts, so no
row per word is ever shuffled, as long as the templates have at most MOST_PLACES
places; more are joined like any table. Votes are grouped by document, template
and diagonal.

Defined results: null text is the empty text, with no words; rows that repeat
are scanned each for itself; empty tables give empty results; the report's columns
replace columns of the same name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import importable, materialise, text_or_empty

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences of public licenses, in lower case words, by label.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "gpl-notice": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike"],
    "cc0": ["cc0 1 0 universal public domain dedication"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "zlib": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "bsl-1.0": ["distributed under the boost software license version 1 0"],
    "lgpl": ["under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl": ["under the terms of the gnu affero general public license as published by the free software foundation"],
    "epl-2.0": ["made available under the terms of the eclipse public license 2 0"],
    "wtfpl": ["do what the fuck you want to public license"],
}
#: Share of a template's places that a span has to hit.
COVERAGE = 0.6
#: Diagonals at most so far apart belong together.
SHIFT = 3
#: A verified span is at most so many times as long as its template, and SHIFT words.
SPREAD = 1.5
#: Places of templates that may be broadcast and stand in the plan.
MOST_PLACES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REPORT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words(text_col: str) -> Column:
    """Runs of digits, letters A-Z in either case and all that isn't ASCII, A-Z in lower case."""
    return F.filter(F.split(F.translate(text_or_empty(text_col), UPPER, LOWER), "[\\x00-/:-`{-\\x7F]+", -1), lambda w: w != "")


def pair_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def template_places(spark: SparkSession, templates: dict[str, list[str]], base: dict[str, str]) -> DataFrame:
    """A row for each place of each template."""
    rows = []
    texts = [(label, phrase, True) for phrase, label in base.items()] + [(label, t, False) for label, own in templates.items() for t in own]
    for number, (label, text, is_base) in enumerate(texts):
        w = text.split()
        rows += [(number, label, is_base, len(w), len(w) - 1, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    found = spark.createDataFrame(rows, "template int, label string, is_base boolean, n_template int, n_places int, place int, first string, second string")
    return found.withColumn("hash", pair_hash(F.col("first"), F.col("second")))


def in_order(votes: list[tuple[int, int]], longest: int) -> tuple[int, int, int]:
    """votes: (place in the text, place in the template). The most distinct places that
    are hit in the template's order within `longest` words, and their first and last
    place in the text."""
    votes = sorted(votes)
    best, end = (0, 0, 0), 0
    for start in range(len(votes)):
        if start and end == len(votes):
            break  # a later window holds less
        at, before = votes[start][0], end
        while end < len(votes) and votes[end][0] - at <= longest:
            end += 1
        if end == before:
            continue
        tails: list[int] = []
        from_, to = [], 0
        for pos, place in votes[start:end]:
            k = bisect_left(tails, place)
            own = pos if not k else from_[k - 1]
            if k == len(tails):
                tails.append(place)
                from_.append(own)
                to = pos
            else:
                tails[k], from_[k] = place, own
        if len(tails) > best[0]:
            best = (len(tails), from_[-1], to)
    return best


VERIFIED = "ls_row long, label string, is_base boolean, start long, stop long, votes long, coverage double"


def best_of(spans: list[tuple]) -> list[tuple]:
    """spans: (label, start, stop, votes, coverage). Those that overlap none of a greater
    coverage: licenses that differ in a word share most of their places."""
    kept, taken = [], []  # taken: disjoint, sorted
    for _, level in groupby(sorted(spans, key=lambda x: -x[4]), key=lambda x: x[4]):
        own = []
        for span in level:
            k = bisect_left(taken, (span[2],))
            if not k or taken[k - 1][1] <= span[1]:
                own.append(span)
        kept += own
        for start, stop in sorted(x[1:3] for x in own):
            k = bisect_left(taken, (start,))
            if k and taken[k - 1][1] > start:
                k -= 1
                start = taken[k][0]
            end = k
            while end < len(taken) and taken[end][0] < stop:
                stop = max(stop, taken[end][1])
                end += 1
            taken[k:end] = [(start, stop)]
    return kept


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = []
            for run in runs:
                hit, first, last = in_order([(v["pos"], v["place"]) for v in run["hits"]], int(SPREAD * run["n_template"]) + SHIFT)
                if hit >= COVERAGE * run["n_places"]:
                    spans.append((run["label"], first, last + 2, hit, hit / run["n_places"]))
            rows += [(row, label, False, start, stop, votes, coverage) for label, start, stop, votes, coverage in best_of(spans)]
        types = (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["ls_row", "label", "is_base", "start", "stop", "votes", "coverage"])


def license_spans(docs: DataFrame, text_col: str = "text", templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scanned, spans). scanned: docs without the text, with ls_row and n_words.
    spans: ls_row, label, is_base, start, stop (words), votes, coverage."""
    spark = docs.sparkSession
    importable(spark)
    places = template_places(spark, TEMPLATES if templates is None else templates, BASE if base is None else base)
    n = places.count()
    few = n <= MOST_PLACES
    with_words = docs.withColumn("__ls_words", words(text_col))
    size = F.greatest(F.size("__ls_words") - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(F.col("__ls_words"), F.lit(1), size), F.slice(F.col("__ls_words"), F.lit(2), size),
        lambda a, b: F.struct(pair_hash(a, b).alias("hash"), a.alias("first"), b.alias("second")),
    )
    numbered = F.transform(pairs, lambda p, i: F.struct(p["hash"].alias("hash"), p["first"].alias("first"), p["second"].alias("second"), i.alias("pos")))
    if few:
        hashes = [r.hash for r in places.select("hash").distinct().collect()]  # of the templates: at most MOST_PLACES
        numbered = F.filter(numbered, lambda p: p["hash"].isin(hashes))
    kept = [c for c in docs.columns if c != text_col and c.lower() not in REPORT]
    scanned = materialise(with_words.select(*kept, F.size("__ls_words").cast("long").alias("n_words"), numbered.alias("__ls_hits"), F.monotonically_increasing_id().alias("ls_row")), "license-hits")
    votes = (
        scanned.select("ls_row", F.explode("__ls_hits").alias("hit")).select("ls_row", "hit.*")
        .join(F.broadcast(places) if few else places, ["hash", "first", "second"])  # both words are compared
        .withColumn("diagonal", F.col("pos") - F.col("place"))
    )
    on_diagonal = votes.groupBy("ls_row", "template", "label", "is_base", "n_template", "n_places", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.collect_list(F.struct("pos", "place")).alias("hits"))
    exact = on_diagonal.where("is_base AND votes = n_places").select("ls_row", "label", "is_base", F.col("diagonal").cast("long").alias("start"), (F.col("diagonal") + F.col("n_template")).cast("long").alias("stop"), "votes", F.lit(1.0).alias("coverage"))
    side_by_side = Window.partitionBy("ls_row", "template").orderBy("diagonal")
    near = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(side_by_side) > SHIFT, F.lit(True)).cast("int")
    merged = (
        on_diagonal.where("NOT is_base").withColumn("new", near).withColumn("run", F.sum("new").over(side_by_side))
        .groupBy("ls_row", "template", "label", "n_template", "n_places", "run")
        .agg(F.flatten(F.collect_list("hits")).alias("hits"))
        .where(F.size(F.array_distinct(F.transform("hits", lambda h: h["place"]))) >= COVERAGE * F.col("n_places"))
        .groupBy("ls_row").agg(F.collect_list(F.struct("label", "n_template", "n_places", "hits")).alias("runs"))
    )
    return scanned.drop("__ls_hits"), exact.unionByName(merged.mapInArrow(_verified, VERIFIED))


def license_report(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word,
    base_labels, labels and score (the best coverage of a template)."""
    scanned, spans = license_spans(docs, text_col)
    of_base = lambda c: F.when(F.col("is_base"), F.col(c))
    found = spans.groupBy("ls_row").agg(
        F.count_if("is_base").alias("n_base"), F.min(of_base("start")).alias("first_word"), F.max(of_base("start")).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(of_base("label"))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"),
    )
    return scanned.join(found, "ls_row", "left").drop("ls_row").fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}, subset=["n_base", "base_labels", "labels", "score"])
