"""Token ids of whole text columns, one tokenizer call per distinct word.

For tokenizers that lower-case, drop white space and never look across it (a word BPE), the
ids of a text are those of its words in a row.  Words are hashed as arrays; only words that a
worker has not met yet go through the tokenizer.  To meet fewer, words of ASCII and Latin-1
letters are lower-cased and part from the punctuation behind them, which changes no id.  Texts
that hold ``<|``, the start of special tokens, go through the tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa

from fleetlens.llm import words

#: words a worker remembers before it starts afresh
REMEMBERED = 1 << 21
#: bytes of text encoded at a time
SLICE_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:127] = True
_PUNCTUATION &= ~_LETTER
_PUNCTUATION[39] = False  # the apostrophe starts contractions
_open: dict[str, "WordTokenizer"] = {}


def tokenizer(path: str) -> "WordTokenizer":
    """The worker's tokenizer of this file."""
    if path not in _open:
        _open[path] = WordTokenizer(path)
    return _open[path]


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes
        self.place = np.zeros(0, np.int64)  # of each known word: its number
        self.offset = np.zeros(1, np.int64)  # of each numbered word's ids
        self.ids = np.zeros(0, np.uint32)

    def encode(self, column: pa.Array):
        """Yield (first row, ids, offsets) of consecutive rows; nulls are empty."""
        data, off = words.buffers(column)
        i, n = 0, len(off) - 1
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1))
            yield (i, *self._encode(_Parts(data[off[i]:off[j]], off[i:j + 1] - off[i])))
            i = j

    def _encode(self, w: "_Parts") -> tuple[np.ndarray, np.ndarray]:
        code, hashes = pd.factorize(w.hash)
        which = self._numbers(w, code, hashes)[code]
        size = np.diff(self.offset)[which]
        cut = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(cut[-1]) + np.repeat(self.offset[which] - cut[:-1], size)]
        offset = cut[w.offset]
        special = _documents_with(w.raw, w.doc_offset, b"<|")
        if not len(special):
            return ids, offset
        parts = [ids[offset[d]:offset[d + 1]] for d in range(len(offset) - 1)]
        for d in special:
            text = w.raw[w.doc_offset[d]:w.doc_offset[d + 1]].tobytes().decode()
            parts[d] = np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _numbers(self, w, code: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the distinct words, after learning the new ones."""
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.any():
            if len(self.known) + int(new.sum()) > REMEMBERED and len(self.known):
                self._forget()
                return self._numbers(w, code, hashes)
            first = np.empty(len(hashes), np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            at_new = first[new]
            raw = w.data.tobytes()
            texts = [raw[s:e].decode() for s, e in zip(w.start[at_new].tolist(), w.end[at_new].tolist())]
            found = [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
            have = len(self.offset) - 1
            self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum([len(x) for x in found])])
            self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
            known = np.concatenate([self.known, hashes[new]])
            place = np.concatenate([self.place, np.arange(have, have + len(found))])
            order = np.argsort(known, kind="stable")
            self.known, self.place = known[order], place[order]
            at = np.searchsorted(self.known, hashes)
        return self.place[at]


class _Parts:
    """Simplified words of some documents, and the documents' own bytes."""

    def __init__(self, raw: np.ndarray, doc_offset: np.ndarray):
        self.raw, self.doc_offset = raw, doc_offset
        start, end = words.bounds(raw, doc_offset)
        low = raw.copy()
        up = (raw >= 65) & (raw <= 90)
        plain = np.ones(len(start), bool)
        latin = np.zeros(len(raw), bool)
        high = raw >= 0x80
        if high.any():
            # Latin-1 letters are 0xC3 and one byte, but for the signs 0x97 and 0xB7
            latin[1:] = (raw[:-1] == 0xC3) & high[1:] & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
            up |= latin & (raw <= 0x9E)
            other = high & ~latin
            other[:-1] &= ~latin[1:]
            if (at := np.flatnonzero(other)).size:
                # words with any other byte stay as they are
                plain[np.searchsorted(start, at, "right") - 1] = False
                for s, e in zip(start[~plain].tolist(), end[~plain].tolist()):
                    up[s:e] = False
        low[up] += 32
        # punctuation at the end of a word, behind a letter or digit
        edge, more = end.copy(), np.flatnonzero(plain)
        while len(more := more[(edge[more] > start[more]) & _PUNCTUATION[raw[edge[more] - 1]]]):
            edge[more] -= 1
        last = np.maximum(edge - 1, 0)
        cut = plain & (edge < end) & (edge > start) & (_LETTER[raw[last]] | latin[last]) if len(start) else plain
        number = np.concatenate([[0], np.cumsum(1 + cut)])
        self.start = np.empty(number[-1], np.int64)
        self.end = np.empty(number[-1], np.int64)
        self.start[number[:-1]] = start
        self.end[number[1:] - 1] = end
        self.end[number[:-1][cut]] = edge[cut]
        self.start[number[1:][cut] - 1] = edge[cut]
        self.data = low
        self.offset = number[np.searchsorted(start, doc_offset)]  # documents + 1 part numbers
        self.hash = words.hashes(low, self.start, self.end)


def _documents_with(data: np.ndarray, offset: np.ndarray, sign: bytes) -> np.ndarray:
    hit = np.flatnonzero((data[:-1] == sign[0]) & (data[1:] == sign[1])) if len(data) > 1 else np.zeros(0, np.int64)
    if not len(hit):
        return hit
    doc = np.searchsorted(offset, hit, "right") - 1
    return np.unique(doc[hit + 1 < offset[doc + 1]])
