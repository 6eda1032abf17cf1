"""Tokenizers of public vocabulary files, one of each in a Python worker."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import cache
from itertools import chain, repeat

import numpy as np

#: Words that a worker remembers; beyond that it starts anew. With their ids they take about 200 MB.
WORDS = 1_000_000
#: Letters of a word that is remembered at most.
LONG = 100
#: Letters that are so in every version of Unicode, and marks that no letter, quote or special token joins.
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARKS = r"!-&(-;=?@\[-`{}~"
_SPACE = r"\x20\x09-\x0d"
_WORD = re.compile(rf"[{_LETTERS}]+(?=[{_MARKS}{_SPACE}]|\Z)|[!-&(-/:;=?@\[-`{{}}~]+(?=[{_LETTERS}{_SPACE}]|\Z)|[^{_SPACE}]+")


class WordIds:
    """Ids of texts by a tokenizer that drops white space and whose words don't depend on each other.

    A text is cut at ASCII white space, and where plain letters meet plain marks;
    each distinct piece is encoded once, as its ids are the same wherever it
    stands. That holds for tokenizers whose normalizer works on characters and
    whose splitter parts letters, marks and white space, as word_bpe_49k.json has
    it. Where anything else joins in, up to the next white space all is one piece.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A special token that parts words in a call; words that hold one themselves aren't remembered.
        self.special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special and not (x.lstrip or x.rstrip or x.single_word)}
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        if self.special:
            between, border = next(iter(self.special.items()))
            parts = [between.join(words[i : i + 1000]) + between for i in range(0, len(words), 1000)]
            found = np.concatenate([np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
            ends = np.flatnonzero(found == border)
            ids, lengths = np.delete(found, ends), np.diff(ends, prepend=-1) - 1
        else:
            each = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            ids, lengths = np.fromiter(chain.from_iterable(each), np.uint32), np.array([len(x) for x in each])
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, np.cumsum(lengths) + self.starts[-1]])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text, as 32-bit numbers."""
        words = [_WORD.findall(t) for t in texts]
        flat = list(chain.from_iterable(words))
        places = self._places(flat)
        missing = np.flatnonzero(places < 0)
        new = {flat[i] for i in missing.tolist()}
        if len(self.place) + len(new) > WORDS:
            self._clear()
            missing, new = np.arange(len(flat)), set(flat)
        if new:
            self._learn([w for w in new if len(w) <= LONG and not any(x in w for x in self.special)])
            places[missing] = self._places([flat[i] for i in missing.tolist()])
        ids, first = self._gathered(places)
        ends = np.cumsum([len(w) for w in words])
        out = []
        for a, b in zip(ends - [len(w) for w in words], ends, strict=True):
            odd = np.flatnonzero(places[a:b] < 0) if new else ()
            own = ids[first[a] : first[b]]
            if len(odd):
                cuts = np.split(own, first[a + odd] - first[a])
                alone = [np.array(self.tokenizer.encode(flat[a + i], add_special_tokens=False).ids, np.uint32) for i in odd]
                own = np.concatenate([cuts[0], *chain.from_iterable(zip(alone, cuts[1:], strict=True))])
            out.append(own)
        return out

    def _places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def _gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words that are known, and of each word the first (one more at the end)."""
        starts = self.starts[places]
        counts = np.where(places < 0, 0, self.starts[np.maximum(places, 0) + (self.starts.size > 1)] - starts)
        first = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[np.arange(first[-1]) + np.repeat(starts - first[:-1], counts)], first


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def vocabulary(name: str) -> str:
    """The path of a file among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
