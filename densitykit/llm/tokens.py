"""Whole texts to token ids with the ``tokenizers`` library, through a memo of chunks.

A text is cut before each single space or line feed that a certain non-space byte follows,
and before a full stop or comma that follows a Latin letter. The byte-level split pattern
always starts a new piece there (it gives a word its one leading space, a run of white space
all but its last character, and keeps letters apart from punctuation), and the word-level one
drops white space and keeps letters apart too, so the ids of the text are the ids of its
chunks, joined. Each worker process keeps the ids of chunks that it has met, at most ``MEMO``
of them, until a task of another operator starts there; the library encodes only new ones, many in one call with the end-of-text token
between them. Special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import numpy as np

from densitykit.llm.common import CACHES, U, row_blocks, span_hashes

#: Chunks kept by a worker process; beyond it the memo starts anew (memory bound, no effect on ids).
MEMO = 2_000_000
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A]] = True
# A byte that cannot begin a white-space character: C2, E1, E2 and E3 begin the non-ASCII ones.
_SAFE = np.ones(256, bool)
_SAFE[:0x21] = False
_SAFE[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
_END = "<|endoftext|>"
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
# Second bytes of the letters U+00C0-U+00FF (all but the signs D7 and F7), whose first byte is C3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: Chunks joined to one text for the library, and such texts that one call of it gets (its results take some 150 bytes a
#: token until they are turned into an array).
_CALL, _CALLS = 256, 16
_known: dict[str, "ChunkEncoder"] = {}
CACHES.append(_known.clear)


def encoder(path: str) -> "ChunkEncoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _known:
        _known[path] = ChunkEncoder(path)
    return _known[path]


class ChunkEncoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._load = lambda: Tokenizer.from_file(path)
        self._plain = None
        self._joined = self._load()  # here the end-of-text token parts the chunks
        self._end = self._joined.token_to_id(_END)
        self._clear()

    @property
    def tokenizer(self):
        """The library's tokenizer to which a special token in a text is text; few texts need it."""
        if self._plain is None:
            self._plain = self._load()
            self._plain.encode_special_tokens = True
        return self._plain

    def _clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, n = [], []
        for i in range(0, len(texts), _CALL * _CALLS):
            some = texts[i:i + _CALL * _CALLS]
            if self._end is None or any("<|" in t for t in some):
                for e in self.tokenizer.encode_batch(some, add_special_tokens=False):
                    flat.append(np.array(e.ids, np.uint32))
                    n.append(np.array([len(e.ids)]))
                continue
            calls = [_END.join(some[j:j + _CALL]) + _END for j in range(0, len(some), _CALL)]
            got = np.concatenate([np.array(e.ids, np.uint32) for e in self._joined.encode_batch_fast(calls, add_special_tokens=False)])
            end = got == self._end
            flat.append(got[~end])
            n.append(np.diff(np.flatnonzero(end), prepend=-1) - 1)
        return np.concatenate(flat), np.concatenate(n).astype(np.int64)

    def _learn(self, keys: np.ndarray, texts: list[str]):
        """Keys ascend and are new."""
        flat, n = self._encode_all(texts)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.empty(max(len(flat), self.used) + 1, np.uint32)])
        self.ids[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = (np.insert(a, where, b) for a, b in ((self.keys, keys), (self.at, at), (self.n, n)))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other (uint32), and each row's number of ids."""
        parts, counts = [], []
        for i, j in row_blocks(off):
            ids, n = self._block(data[off[i]:off[j]], off[i:j + 1] - off[i])
            parts.append(ids)
            counts.append(n)
        return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(data)
        if not size:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        start = _CUT[data]
        start[:-1] &= _SAFE[data[1:]]
        start[-1] = False
        letter = _ALPHA[data]
        letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
        start[1:] |= _STOP[data[1:]] & letter[:-1]
        ends = off[1:][off[1:] > 0] - 1  # a space that ends its row stays in the last chunk
        start[ends] &= _STOP[data[ends]]
        start[off[:-1][off[:-1] < size]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], size)
        h = span_hashes(data, s, e)
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > MEMO:
            self._clear()
        p = np.searchsorted(self.keys, uniq)
        new = np.ones(len(uniq), bool)
        inside = p < len(self.keys)
        new[inside] = self.keys[p[inside]] != uniq[inside]
        if new.any():
            raw = data.tobytes()
            self._learn(uniq[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(s[first[new]], e[first[new]])])
            p = np.searchsorted(self.keys, uniq)
        at, n = self.at[p][inv], self.n[p][inv]
        total = int(n.sum())
        run = np.cumsum(n) - n
        take = np.repeat(at - run, n) + np.arange(total)
        rows = np.searchsorted(s, off)
        cum = np.append(run, total)
        return self.ids[take], cum[rows[1:]] - cum[rows[:-1]]
