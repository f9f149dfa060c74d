"""What the pipeline's language stage drops and keeps."""

from __future__ import annotations

from sparkweft.llm import language_id

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and runs to the river where nothing was lost",
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft zum fluss wo nichts verloren ist",
    "es": "el rápido zorro marrón salta sobre el perro perezoso y corre hacia el río donde nada se ha perdido",
}


def test_spans_decide(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(list(TEXTS.items()) * 10)]
    schema = "doc_id long, text string, lang string"
    model = language_id.learn(spark.createDataFrame(rows, schema))
    mixed = [(100, "\n".join(TEXTS.values()), None), (101, TEXTS["en"] + " " + TEXTS["en"] + "\n" + TEXTS["de"], None), (102, "123 !!", None)]
    kept = language_id.keep_identified(spark.createDataFrame(rows + mixed, schema), model)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(30), 101]


def test_nothing_learned_keeps_texts_with_letters(spark):
    rows = [(1, "a text without a label", None), (2, None, None), (3, "123 !!", None), (4, "привет", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language_id.keep_identified(docs, language_id.learn(docs)).collect()) == [1, 4]
