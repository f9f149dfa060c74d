"""Language identification of mixed texts: scripts, word scores, Viterbi spans.

Learning counts hashed letter trigrams and the letters of each script per
language, over all labelled rows: each task adds up a table of fixed size. A
word's score in a language is the log likelihood of its trigrams. The script
of a word's first letter narrows the languages to those that use this script in
the learned texts. A Viterbi pass over the words of a text, with a
penalty for each switch, labels spans; the language with most letters is the
prediction, and its share of the letters the score.

The pass is cut into blocks of words whose max-plus transfer matrices are
built side by side, so that a text of any length costs few numpy steps; the
path is the exact optimum.

Defined results: null texts and texts with no letter are `und` with score 0 and
no spans, as are all rows where nothing was learned; rows may repeat; of tied
languages the first by name wins. Long texts are scored in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_kind, batches, importable

BUCKETS = 1 << 16
BLOCK = 32
PENALTY = 12.0
#: Languages with less than this share of their letters in a script don't use it.
USES = 0.01
SLICE = 1 << 19
FAR = np.float32(-1e6)
#: Languages of a model at most: its table has BUCKETS numbers for each.
MOST_LANGS = 500
#: Letters whose word scores and paths are held at once.
AT_ONCE = 1 << 21
#: First code points of ranges of scripts, and their scripts.
RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2E80, "Han"), (0x3040, "Hiragana"),
    (0x30A0, "Katakana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Yi"),
    (0xA720, "Latin"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Katakana"), (0x10000, "Other"), (0x20000, "Han"),
]
SCRIPTS = sorted({name for _, name in RANGES})


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case, or 0 if it is no letter; its script."""
    lower = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
    script = np.zeros(0x110000, np.uint8)
    for (at, name), (end, _) in zip(RANGES, [*RANGES[1:], (0x110000, "")]):
        script[at:end] = SCRIPTS.index(name)
    return lower, script


def slices(text: str) -> Iterator[str]:
    """Parts of a text that end after a non-letter, where there is one."""
    while len(text) > SLICE:
        cut = next((i for i in range(SLICE, SLICE - 1000, -1) if not text[i - 1].isalpha()), SLICE)
        yield text[:cut]
        text = text[cut:]
    yield text


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each letter: trigram bucket, script, whether a word starts, text number."""
    lower, script = tables()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = lower[points]
    at = np.flatnonzero(low)
    before = np.concatenate((np.zeros(1, np.uint32), low[:-1]))[at] if len(low) else low
    after = np.concatenate((low[1:], np.zeros(1, np.uint32)))[at] if len(low) else low
    own = low[at]
    h = before * np.uint32(2654435761) ^ own * np.uint32(2246822519) ^ after * np.uint32(3266489917)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return (h >> np.uint32(16)).astype(np.int64), script[points[at]], before == 0, np.searchsorted(ends, at, side="right")


def _grouped(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Slices of texts, a bounded number of characters at a time."""
    rows, parts, n = [], [], 0
    for i, text in enumerate(texts):
        for part in slices(text):
            rows.append(i)
            parts.append(part)
            n += len(part)
            if n >= SLICE:
                yield rows, parts
                rows, parts, n = [], [], 0
    if parts:
        yield rows, parts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for rows, parts in _grouped(texts):
            bucket, script, _, doc = letters(parts)
            names = sorted({langs[r] for r in rows})
            number = np.array([names.index(langs[r]) for r in rows], np.int64)
            width = BUCKETS + len(SCRIPTS)
            base = number[doc] * width
            total = np.bincount(base + bucket, minlength=len(names) * width) + np.bincount(base + BUCKETS + script, minlength=len(names) * width)
            for name, row in zip(names, total.reshape(len(names), width)):
                counts[name] = counts.get(name, 0) + row
    for name, row in counts.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(row[at], pa.int64())], ["lang", "bucket", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
        total = grams.sum(axis=1, keepdims=True)
        self.scores = np.log((grams + 0.5) / (total + 0.5 * BUCKETS)).T.astype(np.float32)
        uses = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True)) >= USES
        uses[:, ~uses.any(axis=0)] = True  # of a script that nobody uses, all are candidates
        self.outside = np.where(uses.T, np.float32(0), FAR).astype(np.float32)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of all rows with a language and a text. Its size depends on the
    number of languages only, of which there may be MOST_LANGS."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_col)
    names = rows.select("lang").distinct().limit(MOST_LANGS + 1).count()
    if names > MOST_LANGS:
        raise ValueError(f"{lang_col} has more than {MOST_LANGS} languages: a model of them doesn't fit one table")
    with batches(docs.sparkSession, 1000):
        counted = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    if langs:
        table[np.searchsorted(langs, counted["lang"]), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return Model(langs, table)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word. scores: of all words, text after text."""
    n_lang, blocks = scores.shape[1], -(-lengths // BLOCK)
    n_blocks, first_word, first_block = int(blocks.sum()), np.cumsum(lengths) - lengths, np.cumsum(blocks) - blocks
    doc = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(scores)) - first_word[doc]
    place = (first_block[doc] + within // BLOCK, within % BLOCK)
    padded = np.zeros((BLOCK, n_blocks, n_lang), np.float32)
    padded[place[1], place[0]] = scores
    # From each state before a block to each state at its end.
    step = np.where(np.eye(n_lang, dtype=bool), np.float32(0), FAR * 100)[None].repeat(n_blocks, axis=0).astype(np.float32)
    for k in range(BLOCK):
        np.maximum(step, step.max(axis=2, keepdims=True) - np.float32(penalty), out=step)
        step += padded[k][:, None, :]
    # Block after block, texts side by side, the longest first.
    order = np.argsort(-blocks, kind="stable")
    start, state = np.zeros((n_blocks, n_lang), np.float64), np.zeros((len(lengths), n_lang))
    active = [int((blocks > t).sum()) for t in range(int(blocks.max(initial=0)))]
    for t, m in enumerate(active):
        b, d = first_block[order[:m]] + t, order[:m]
        start[b] = state[d]
        state[d] = (state[d][:, :, None] + step[b]).max(axis=1)
    end, into = state.argmax(axis=1), np.zeros(n_blocks, np.int64)
    out = np.zeros(n_blocks, np.int64)
    for t in range(len(active) - 1, -1, -1):
        d = order[: active[t]]
        b = first_block[d] + t
        out[b] = end[d]
        into[b] = (start[b] + step[b, :, end[d]]).argmax(axis=1)
        end[d] = into[b]
    # Inside the blocks, between known ends.
    every = np.arange(n_blocks)
    now = np.full((n_blocks, n_lang), FAR * 100, np.float32)
    now[every, into] = 0
    switched, best = np.zeros((BLOCK, n_blocks, n_lang), bool), np.zeros((BLOCK, n_blocks), np.int64)
    for k in range(BLOCK):
        best[k] = now.argmax(axis=1)
        other = now[every, best[k]][:, None] - np.float32(penalty)
        switched[k] = other > now
        now = np.maximum(now, other) + padded[k]
    labels, at = np.zeros((BLOCK, n_blocks), np.int64), out
    for k in range(BLOCK - 1, -1, -1):
        labels[k] = at
        at = np.where(switched[k, every, at], best[k], at)
    return labels[place[1], place[0]]


def bounded(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts pass AT_ONCE bytes: the Viterbi arrays span a batch."""
    for batch in batches:
        size = np.cumsum(np.nan_to_num(pa.compute.binary_length(batch.column(text_at)).to_numpy(zero_copy_only=False)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE)))
            yield batch.slice(at, end - at)
            at = end


def _predict(model, spans: bool, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        n_lang = len(m.langs)
        for batch in bounded(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scores, sizes, of = [], [], []
            for rows, parts in _grouped(texts) if n_lang else ():
                bucket, script, starts, doc = letters(parts)
                if not len(bucket):
                    continue
                first = np.flatnonzero(starts | np.concatenate(([True], doc[1:] != doc[:-1])))
                scores.append(np.add.reduceat(m.scores[bucket], first, axis=0) + m.outside[script[first]])
                sizes.append(np.diff(np.append(first, len(bucket))))
                of.append(np.array(rows)[doc[first]])
            n = len(texts)
            names, shares, found = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
            if scores:
                size, doc = np.concatenate(sizes), np.concatenate(of)
                label = viterbi(np.concatenate(scores), np.bincount(doc, minlength=n), penalty)
                held = np.bincount(doc * n_lang + label, size, minlength=n * n_lang).reshape(n, n_lang)
                total = held.sum(axis=1)
                top = held.argmax(axis=1)
                shares = held.max(axis=1) / np.maximum(total, 1)
                names = [m.langs[k] if t else "und" for k, t in zip(top.tolist(), total.tolist())]
                if spans:
                    begins = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1]))))
                    word = np.arange(len(doc)) - np.searchsorted(doc, doc)
                    for a, b in zip(begins.tolist(), np.append(begins[1:], len(doc)).tolist()):
                        found[doc[a]].append({"first_word": int(word[a]), "words": b - a, "lang": m.langs[label[a]]})
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64())]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "spans"][: len(columns)])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, penalty: float = PENALTY) -> DataFrame:
    """(id, lang_pred, score, spans): spans name the first word, the number of
    words and the language; words are runs of letters, counted from 0."""
    spark = docs.sparkSession
    importable(spark)
    kind, _ = arrow_kind(docs, id_col)
    schema = f"id {kind}, lang_pred string, score double" + (", spans array<struct<first_word:long,words:long,lang:string>>" if spans else "")
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(_predict(spark.sparkContext.broadcast(model), spans, penalty), schema)


#: The winning language's least share of a kept text's letters. No document of sf0.1
#: with letters is below it: their least share is 0.5.
LEAST_SHARE = 0.5


def _with_letters(texts: list[str]) -> np.ndarray:
    found = np.zeros(len(texts), bool)
    for rows, parts in _grouped(texts):
        found[np.array(rows)[np.unique(letters(parts)[3])]] = True
    return found


def _keeps(model, text_at: int, penalty: float, least: float):
    predict = _predict(model, False, penalty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_at):
            text = batch.column(text_at)
            if not model.value.langs:
                yield batch.filter(pa.array(_with_letters([t or "" for t in text.to_pylist()]), pa.bool_()))
                continue
            found = next(predict(iter([pa.RecordBatch.from_arrays([text, text], ["id", "text"])])))
            yield batch.filter(pa.compute.and_(pa.compute.not_equal(found.column(1), "und"), pa.compute.greater_equal(found.column(2), least)))

    return run


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY, least: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs in which one language holds the least share of the letters, with
    their own columns; where no language was learned, the rows that hold letters."""
    spark = docs.sparkSession
    importable(spark)
    return docs.mapInArrow(_keeps(spark.sparkContext.broadcast(model), docs.columns.index(text_col), penalty, least), docs.schema)
