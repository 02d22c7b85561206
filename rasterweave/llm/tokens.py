"""Token ids of whole texts through the tokenizers library, each distinct word encoded once.

The tokenizer file must drop white space and end each word's last token with ``</w>``; then the ids of a text are
the ids of its blank-separated words in turn. A worker remembers the first ``REMEMBERED`` words that it meets, or as many
as the caller says, so memory stays bounded; other words are encoded once in each batch. Words are encoded, and ids put
together, ``AT_ONCE`` at a time, and a task of another operator drops a worker's encoders. Special strings such as ``<|endoftext|>`` are
matched before lower-casing, so texts that hold ``<|`` keep their case.

Defined cases: a null text is the empty one and has no ids; repeated texts are encoded alike, each by itself; a text of
any length is encoded whole; no texts give no ids.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from rasterweave.llm.streams import keep
from rasterweave.llm.wordhash import blocks

#: Words that a worker remembers, words in a line handed to the tokenizer, and words encoded or put together at once.
REMEMBERED = 400_000
LINE_WORDS = 256
AT_ONCE = 1 << 14
#: Bytes of text to encode at once; a single longer text is encoded as a whole.
SLICE_BYTES = 4 << 20

WORD_BPE = "word_bpe_49k.json"

_BY_PATH: dict[tuple[str, int | None], "WordEncoder"] = {}


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Where the public tokenizer file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None = None, remembered: int | None = None) -> "WordEncoder":
    """The worker's encoder for a tokenizer file; None: the 49k word vocabulary. ``remembered``: see ``WordEncoder``."""
    name = path or tokenizer_path(), remembered
    if name not in _BY_PATH:
        _BY_PATH[name] = WordEncoder(*name)
    keep(_BY_PATH)
    return _BY_PATH[name]


class _Index(dict):
    """Gives each new word the next number and notes it in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """``remembered``: most words to remember; None: ``REMEMBERED``. Fewer take less memory and more time; ids are the same."""

    def __init__(self, path: str, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.index, self.remembered = _Index(), remembered
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint16 if size <= 1 << 16 else np.uint32)

    def _encode_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and how many each has."""
        out = []
        for at in range(0, len(words), AT_ONCE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[at : at + AT_ONCE], add_special_tokens=False)]
            out.append((np.fromiter(chain.from_iterable(found), self.ids.dtype), np.fromiter(map(len, found), np.int32, len(found))))
        return np.concatenate([i for i, _ in out]), np.concatenate([n for _, n in out])

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only: many share a line, and their last tokens mark where each ends."""
        lines = [words[i : i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        out = []
        for at in range(0, len(lines), AT_ONCE // LINE_WORDS):
            some = lines[at : at + AT_ONCE // LINE_WORDS]
            for line, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(x) for x in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.ids.dtype)
                stops = np.flatnonzero(self.ends[ids]) + 1
                whole = len(stops) == len(line) and stops[-1] == len(ids)
                out.append((ids, np.diff(stops, prepend=0)) if whole else self._encode_each(line))
        return np.concatenate([i for i, _ in out]), np.concatenate([n for _, n in out])

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in turn, and where each begins (and the last ends)."""
        upto = np.zeros(len(place) + 1, np.int64)
        np.cumsum(self.length[place], out=upto[1:])
        ids = np.empty(upto[-1], self.ids.dtype)
        for at in range(0, len(place), AT_ONCE):
            some, ends = place[at : at + AT_ONCE], upto[at : at + AT_ONCE + 1]
            ids[ends[0] : ends[-1]] = self.ids[np.repeat(self.start[some] - ends[:-1], np.diff(ends)) + np.arange(ends[0], ends[-1])]
        return ids, upto

    def _add(self, places: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.length[places] = counts
        self.start[places] = len(self.ids) + np.cumsum(counts, dtype=np.int64) - counts
        self.ids = np.concatenate([self.ids, ids])

    def _learn(self) -> None:
        """Encodes the words that are new in the index: letters, letters and a stop, and others, each kind at once."""
        index, known = self.index, len(self.length)
        plain, other, joined = ([], []), ([], []), ([], [])
        at = 0
        while at < len(index.new):  # the stems of joined words may be new themselves
            text = (word := index.new[at]).decode("utf-8", "replace")
            if text.isalpha():
                plain[0].append(at)
                plain[1].append(text)
            elif text[-1] in ".,;:!?" and text[:-1].isalpha():
                joined[0].append(at)
                joined[1].extend((index[word[:-1]], index[word[-1:]]))
            else:
                other[0].append(at)
                other[1].append(text)
            at += 1
        self.start = np.concatenate([self.start, np.zeros(at, np.int64)])
        self.length = np.concatenate([self.length, np.zeros(at, np.int32)])
        for (places, words), encode in ((plain, self._encode_plain), (other, self._encode_each)):
            if words:
                self._add(known + np.array(places), *encode(words))
        if joined[0]:
            ids, upto = self._gather(np.array(joined[1]))
            self._add(known + np.array(joined[0]), ids, np.diff(upto[::2]))

    def _forget(self) -> None:
        """Keeps the first words only; those of this batch beyond them go."""
        extra = len(self.index) - (REMEMBERED if self.remembered is None else self.remembered)
        if extra > 0:
            for word in self.index.new[-extra:]:
                del self.index[word]
            n = len(self.index)
            self.ids, upto = self._gather(np.arange(n))
            self.start, self.length = upto[:-1], self.length[:n]
        self.index.new = []

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each text has. Null is the empty text."""
        parts = [self._encode(texts[a:b]) for a, b in blocks(texts, SLICE_BYTES)]
        none = np.zeros(0, self.ids.dtype), np.zeros(0, np.int64)
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(none, *parts, strict=True))

    def _encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        look, places, words = self.index.__getitem__, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                parts = (text if b"<|" in text else text.lower()).split()
                words[i] = len(parts)
                places.append(np.fromiter(map(look, parts), np.int32, len(parts)))
        if self.index.new:
            self._learn()
        place = np.concatenate(places) if places else np.zeros(0, np.int32)
        ids, upto = self._gather(place)
        edges = np.concatenate([[0], np.cumsum(words)])
        counts = np.diff(upto[edges])
        self._forget()
        return ids, counts
