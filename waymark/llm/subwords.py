"""Subword ids by a public tokenizer file, with a cache of the words seen.

The word-end BPE splits at white space and never joins across it, so a text's ids are those of its words in a row.
Words repeat much more than texts, and each is encoded once per worker while it stays in the cache.

Defined cases: an empty text, or one of white space alone, has no ids; callers give texts, never null; texts that repeat
have the same ids; a text of any length is encoded whole, word by word, words beyond LONGEST_WORD characters without
staying in the cache; texts in which Python and the tokenizer may differ on white space go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "word_bpe_49k.json"
#: Words in each of the two generations that a worker keeps (about 200 bytes a word), unless it is told otherwise.
MOST_WORDS = 350_000
LONGEST_WORD = 64
#: Characters that normalise alone and lower-case the same in any context; other words go to the tokenizer singly.
PLAIN = re.compile(r"[\x21-\x7e\xa1-\xff]+").fullmatch
#: Latin-1 characters other than white space and printable ones.
CONTROLS = bytes([*range(9), *range(14, 32), *range(127, 161)])
#: Fixed value: the tokenizer file's own split pattern, for Latin-1 characters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+").findall


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Subwords:
    """ids(texts): for each text the little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str | None = None, most: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known = Generations(most)

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Put words into the cache: lower-cased Latin-1 ones as pieces, all new pieces encoded together. Letters alone
        are a piece, a closing mark is a piece of its own, other words are split by the pattern."""
        known = self.known
        pieces = {w for w in words if w.isalpha()}
        others = words - pieces
        closed = [w for w in others if w[:-1].isalpha() and not w[-1].isalnum()]
        parts = {w: PIECES(w) for w in others.difference(closed)}
        pieces.update([w[:-1] for w in closed], [w[-1] for w in closed], *parts.values())
        fresh = [p for p in pieces if known.get(p) is None]
        if fresh:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(fresh):
                raw, start = ids.tobytes(), 0
                for piece, stop in zip(fresh, (stops * 4).tolist(), strict=True):
                    known[piece] = raw[start:stop]
                    start = stop
            else:
                known.update(self.singly(fresh))
        for w in closed:
            known[w] = known[w[:-1]] + known[w[-1]]
        for w, of in parts.items():
            known[w] = b"".join([known[p] for p in of])

    def learn_any(self, words: set[str]) -> None:
        """Put words as they stand into the cache, from texts beyond Latin-1."""
        lower = {w: w.lower() for w in words if PLAIN(w)}
        self.learn({w for w in lower.values() if self.known.get(w) is None})
        self.known.update({w: self.known[x] for w, x in lower.items()})
        self.known.update(self.singly(list(words - lower.keys())))

    def singly(self, words: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(x.ids, "<u4").tobytes() for w, x in zip(words, found, strict=True)}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Look all words up, learn the new ones, fill the gaps that they left."""
        known, fresh = self.known, ([], [])
        split, found = [words_of(t) for t in texts], []
        for words, lower in split:
            known.fresh = fresh[lower]
            found.append(None if words is None else list(map(known.__getitem__, words)))
        long = {w: self.direct(w) for words in fresh for w in words if len(w) > LONGEST_WORD}
        for words, learn in zip(fresh, (self.learn_any, self.learn), strict=True):
            if words:
                learn(set(words) - long.keys())
        for (words, _), values in zip(split, found, strict=True):
            for i in gaps_in(values):
                values[i] = long.get(words[i]) or known[words[i]]
        for w in long:
            del known[w]
        known.age()
        return [self.direct(text) if values is None else b"".join(values) for text, values in zip(texts, found, strict=True)]


class Generations(dict):
    """Words and their ids. One that is missing is promoted from the old, or noted as fresh and holds None until it is
    learnt. When the young are too many they become the old, and those that nobody asked for meanwhile go."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.old: dict[str, bytes] = {}
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> bytes | None:
        value = self[word] = self.old.get(word)
        if value is None:
            self.fresh.append(word)
        return value

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def gaps_in(values: list[bytes | None] | None) -> list[int]:
    """Where None stands."""
    out, at = [], -1
    for _ in range(values.count(None) if values else 0):
        at = values.index(None, at + 1)
        out.append(at)
    return out


def words_of(text: str) -> tuple[list[str] | None, bool]:
    """The text's words, and whether they are lower-cased, as in a text all of whose characters are Latin-1: these
    lower-case alike in any context. No words if Python and the tokenizer may differ on the text's white space."""
    if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return None, False
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split(), False
    if len(raw.translate(None, CONTROLS)) < len(raw):
        return None, False
    return text.lower().split(), True


_subwords: dict[str, Subwords] = {}


def shared_subwords(path: str, most: int = MOST_WORDS) -> Subwords:
    """One per worker, so that its cache lives across tasks."""
    if path not in _subwords:
        _subwords[path] = Subwords(path, most)
    return _subwords[path]
