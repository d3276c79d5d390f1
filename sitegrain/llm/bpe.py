"""Byte-level BPE ids of many texts by the ``tokenizers`` library, each distinct word encoded once per worker.

The pre-tokenizer of a byte-level BPE always cuts before a space that follows something else, so ids of a text are those of its
space-separated words, each with its leading space, as long as no two spaces meet and the text doesn't end in one. Other texts,
and those that hold the string of a special token, are encoded whole.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

#: Words of a generation that a worker remembers; those of the last two are known. Only speed depends on it.
REMEMBERED = 450_000
#: Words that are encoded as one text.
TOGETHER = 10_000


class Memory:
    """What was found for the words met of late."""

    def __init__(self) -> None:
        self.found: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def renew(self) -> None:
        """Begin a generation if this one is full."""
        if len(self.found) > REMEMBERED:
            self.older, self.found = self.found, {}

    def missing(self, words: set[str]) -> list[str]:
        """The words that nothing is known of; all others can then be read from ``found``."""
        new = []
        for word in words.difference(self.found):
            if word in self.older:
                self.found[word] = self.older[word]
            else:
                new.append(word)
        return new


def cut_at(ids: bytes, starts: np.ndarray, n: int) -> list[bytes] | None:
    """The ids of each of n words from those of all of them, if so many begin there."""
    cuts = (4 * np.flatnonzero(starts[np.frombuffer(ids, "<u4")])).tolist()
    return [ids[a:b] for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)] if len(cuts) == n and (not n or cuts[0] == 0) else None


class Encoder:
    """``encode`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, ordinary_specials: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary_specials
        self.specials = [] if ordinary_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Memory()
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space
        self.starts[[i for piece, i in vocabulary.items() if piece.startswith("Ġ")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words with a leading space, many words in one text, which is cut at the ids that begin with a space."""
        out = []
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            found = cut_at(self._ids([" " + " ".join(part)])[0], self.starts, len(part))
            out += self._ids([f" {w}" for w in part]) if found is None else found
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if "  " in t or t.endswith(" ") or any(s in t for s in self.specials)]
        other = set(whole)
        split = [None if i in other else t.split(" ") for i, t in enumerate(texts)]
        starts = iter(self._ids([words[0] for words in split if words]))
        wholes = iter(self._ids([texts[i] for i in whole]))
        self.words.renew()
        known = self.words.found
        # each word is looked up once; only what wasn't found is looked at again
        found = [[next(wholes)] if words is None else list(map(known.get, words)) for words in split]
        lacking = [[i for i, ids in enumerate(own) if ids is None] if None in own else () for own in found]
        met = {words[i] for words, places in zip(split, lacking, strict=True) if places for i in places if i}
        new = self.words.missing(met)
        known.update(zip(new, self._word_ids(new), strict=True))
        for words, own, places in zip(split, found, lacking, strict=True):
            for i in places:
                own[i] = known.get(words[i])
            if words:
                own[0] = next(starts)  # the first word has no space before it
        return [b"".join(own) for own in found]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, ordinary_specials: bool = False) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    key = path, ordinary_specials
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
