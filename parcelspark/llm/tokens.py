"""Token ids of whole texts by the public word BPE vocabulary, with a cache of words."""

from __future__ import annotations

import os

import numpy as np

#: Known words that a Python worker keeps; then it starts anew.
CACHE_WORDS = 700_000
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds:
    """The vocabulary drops white space, lower-cases, and never merges across white space, so a text's ids are those of its words in turn.

    Words are cut at ASCII white space only; what other white space does is left to the tokenizer. Upper-case ASCII letters are lowered first, as the tokenizer would do. A text that may hold a special token's string goes to the tokenizer whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        # Letters, and the punctuation after them, are tokenized apart, so both are looked up alone.
        cut = [(w, c) for w in new if (c := w.rstrip(PUNCTUATION)).isalpha() or c.decode().isalpha()]
        tails = [(w, c, w[len(c) :]) for w, c in cut if len(c) < len(w)]
        letters = list({c for _, c in cut}.difference(known))
        other = list((new.difference([w for w, _ in cut]) | {t for _, _, t in tails}).difference(known))
        if other:
            known.update(zip(other, self._encode([w.decode() for w in other]), strict=True))
        # Each run of letters ends with one token that is marked as an end, so all of them can be encoded as one text.
        if letters:
            raw = self._encode([b" ".join(letters).decode()])[0]
            ends = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, dtype="<u4")]) + 1)).tolist()
            if len(ends) == len(letters):
                known.update(zip(letters, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))
            else:
                known.update(zip(letters, self._encode([w.decode() for w in letters]), strict=True))
        for w, core, tail in tails:
            known[w] = known[core] + known[tail]

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as unsigned little-endian 32-bit numbers; a null text has none."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        words = [t.encode().lower().split() if t and "<|" not in t else [] for t in texts]
        if new := set().union(*words).difference(self.known):
            self._learn(new)
        known = self.known
        return [b"".join([known[w] for w in ws]) if ws or not t or "<|" not in t else self._encode([t])[0] for ws, t in zip(words, texts, strict=True)]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python worker, kept between its tasks."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
