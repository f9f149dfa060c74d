"""BPE encoding by forced boundaries, and decoding.

A pair of bytes that stands side by side inside no token of the vocabulary can
never be joined by a merge: between two such bytes there is a cut, whatever the
context. Each pre-token is split at its certain cuts, the fragments are encoded
independently of each other, and their ids are concatenated. Encoded pre-tokens
are kept in a bounded cache; a task's memory doesn't grow with its input.

Texts are encoded exactly as the tokenizers library does with the same file and
add_special_tokens=False: strings of special tokens inside a text become their
ids, and texts with characters whose class may differ between Unicode versions
are cut into pre-tokens by the library itself.

Defined results: null text is the empty text, with no ids; rows may repeat.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

#: Letters, digits and white space among the characters that UNSURE lets pass.
LETTER, DIGIT, SPACE = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\t-\r "
#: The pre-token patterns of the two kinds of vocabulary files.
BYTE_LEVEL_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+"
#: Characters whose class, case and normal form no Unicode version has changed.
UNSURE = re.compile("[^\\t-\\r -~\u00a1-\u00ac\u00ae-\u012f\u0131-\u0148\u014a-\u017e\u2010-\u2027]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files:
    visible Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in set(visible) else next(rest)) for b in range(256)]


#: Marks a word that no space stands before; no plain text has it.
NO_SPACE = "\x01"


class Generations:
    """A bounded cache of two generations: what is asked for while the younger
    fills moves into it, the rest is forgotten with the older."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys) -> list:
        """Afterwards `young` holds every key but the returned ones."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for key in keys:
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    out.append(key)
        return out


class Encoder:
    """Encodes texts by a vocabulary file of either kind."""

    def __init__(self, path: str, cache: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.merger = Tokenizer(self.library.model)  # merges only: no pre-tokens, no special tokens
        self.many = Tokenizer(self.library.model)  # parted by spaces
        self.many.pre_tokenizer = WhitespaceSplit()
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.folds = spec["normalizer"] is not None
        self.pattern = re.compile(WORD_PATTERN if self.folds else BYTE_LEVEL_PATTERN)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.special_in = "<|"
        self.runs = re.compile("[\t-\r ]{2}|[\t\x0b-\r]")
        alphabet = byte_alphabet()
        self.alphabet = dict(enumerate(alphabet))
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.token_bytes = [b""] * (1 + max([*spec["model"]["vocab"].values(), *self.special.values()]))
        self.joined = np.zeros((256, 256), bool)
        self.ends_word = np.zeros(len(self.token_bytes), bool)
        for token, i in spec["model"]["vocab"].items():
            inner = token.removesuffix(self.suffix) if self.suffix else token
            self.ends_word[i] = inner is not token and inner != token
            own = bytes(byte_of[c] for c in inner)
            self.token_bytes[i] = own
            if len(own) > 1:
                as_array = np.frombuffer(own, np.uint8)
                self.joined[as_array[:-1], as_array[1:]] = True
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(len(self.token_bytes))]
        self.words_known, self.pretokens_known = Generations(cache), Generations(cache)

    def cuts(self, data: bytes) -> np.ndarray:
        """Places between two bytes that stand side by side in no token."""
        each = np.frombuffer(data, np.uint8)
        return np.flatnonzero(~self.joined[each[:-1], each[1:]]) + 1

    def _merge(self, pretokens: list[str]) -> list[bytes]:
        """The ids of each pre-token: all are cut at once, the fragments are
        encoded independently, and their ids concatenated."""
        if self.suffix:
            return self._merge_whole(pretokens)
        encoded = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        data = b"".join(encoded)
        ends = np.cumsum([len(e) for e in encoded])
        at = np.union1d(self.cuts(data), ends)
        stops = at.tolist()
        shown = data.decode("latin-1").translate(self.alphabet)
        fragments = [shown[a:b] for a, b in zip([0, *stops[:-1]], stops)]
        several = list(dict.fromkeys(fragments))
        ids = {f: array("I", e.ids).tobytes() for f, e in zip(several, self.merger.encode_batch_fast(several, add_special_tokens=False))}
        out, last = [], 0
        for n in (np.searchsorted(at, ends) + 1).tolist():
            out.append(ids[fragments[last]] if n == last + 1 else b"".join([ids[f] for f in fragments[last:n]]))
            last = n
        return out

    def _merge_whole(self, pretokens: list[str]) -> list[bytes]:
        """With an end-of-word suffix, which depends on what follows, pre-tokens stay
        whole; as only their last tokens bear it, many are encoded as one string."""
        out = []
        for at in range(0, len(pretokens), 500):
            # Visible ASCII stands for itself in the alphabet.
            shown = [p if p.isascii() and p.isprintable() else p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet) for p in pretokens[at : at + 500]]
            ids = np.array(self.many.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids, "<u4")
            data, stops = ids.tobytes(), ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            out += [data[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def _known(self, pretokens) -> dict[str, bytes]:
        missing = self.pretokens_known.missing(pretokens)
        if missing:
            self.pretokens_known.young.update(zip(missing, self._merge(missing)))
        return self.pretokens_known.young

    def words(self, text: str) -> list[str] | None:
        """The words of a plain text, or None: runs of white space depend on
        each other, so only single spaces and line feeds are certain ends."""
        if UNSURE.search(text) or self.special_in in text:
            return None
        if self.folds:
            return text.lower().split()
        if self.runs.search(text):
            return None
        return (NO_SPACE + text.replace("\n", f" \n {NO_SPACE}")).split(" ")

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """A word stands between two single spaces, itself without one. In
        byte-level vocabularies the space before belongs to it, unless it begins
        with NO_SPACE. A word of letters alone is one pre-token."""
        missing = self.words_known.missing(words)
        find, folds, known = self.pattern.findall, self.folds, self.words_known.young
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            plain = [w for w in some if w.isalpha()]
            known.update(zip(plain, self._merge(plain if folds else [" " + w for w in plain])))
            other = [w for w in some if not w.isalpha()]
            cut = [find(w if folds or w == "\n" else w[1:] if w[:1] == NO_SPACE else " " + w) for w in other]
            ids = self._known({p for c in cut for p in c})
            known.update((w, ids[c[0]] if len(c) == 1 else b"".join([ids[p] for p in c])) for w, c in zip(other, cut))
        return known

    def _other(self, text: str) -> bytes:
        """Ids of a text that words() doesn't take."""
        out = []
        for part in self.at_special.split(text) if self.special_in in text else [text]:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            if UNSURE.search(part):
                whole = self.library.normalizer.normalize_str(part) if self.folds else part
                each = (whole[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(whole))
            else:
                each = (m.group() for m in self.pattern.finditer(part.lower() if self.folds else part))
            while some := list(islice(each, 100_000)):
                ids = self._known(dict.fromkeys(some))
                out += map(ids.__getitem__, some)
        return b"".join(out)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts of any length."""
        out: list = [None] * len(texts)
        waiting, size = [], 0
        # Nothing here makes cycles, and the caches are large: collecting them is in vain.
        collects = gc.isenabled()
        gc.disable()
        try:
            for k, text in enumerate(texts):
                words = self.words(text)
                if words is None:
                    out[k] = np.frombuffer(self._other(text), "<u4")
                    continue
                found = list(map(self.words_known.young.get, words))
                if None not in found:
                    out[k] = np.frombuffer(b"".join(found), "<u4")
                    continue
                gaps = [i for i, ids in enumerate(found) if ids is None]
                waiting.append((k, found, gaps, [words[i] for i in gaps]))
                size += len(words)
                if size > 1 << 20:
                    self._fill(waiting, out)
                    waiting, size = [], 0
            self._fill(waiting, out)
        finally:
            if collects:
                gc.enable()
        return out

    def _fill(self, waiting: list, out: list) -> None:
        """Texts with words that were not known."""
        known = self._learn(set().union(*[words for _, _, _, words in waiting]))
        for k, found, gaps, words in waiting:
            for i, word in zip(gaps, words):
                found[i] = known[word]
            out[k] = np.frombuffer(b"".join(found), "<u4")

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def shown(self, ids: np.ndarray) -> str:
        """Ids as decimal numbers joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file in each Python worker."""
    return Encoder(path)
