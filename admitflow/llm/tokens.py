"""Token ids of whole texts, by the vocabulary file of a public tokenizer.

A byte-level BPE of this family never joins a text across a single space or
line break that stands between two characters that are no white space. So a
column is cut there into units (on bytes, with numpy), each distinct unit is
encoded once per task and the ids of the rows are gathered. Units go through
the merge ranks of the same vocabulary, which give the tokenizer's ids several
times faster; a row that holds the text of a special token goes to the
tokenizer whole.
"""

from __future__ import annotations

import base64
import os
from itertools import chain

import numpy as np

from admitflow.llm.wordhash import Words, hash_words

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary as merge ranks
SPECIAL_MARK = b"<|"
MEMO_UNITS = 1_000_000  # distinct units kept by a task before it starts anew

_WS = np.zeros(256, dtype=bool)
_WS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
# fixed values: UTF-8 bytes of the white space outside ASCII
_WIDE = ([b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
         + [bytes([0xE2, 0x80, k]) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)])


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which a unit starts; every row that is not empty starts one."""
    n = len(data)
    white = _WS[data]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        for wide in _WIDE:
            at = lead[lead + len(wide) <= n]
            for k, byte in enumerate(wide):
                at = at[data[at + k] == byte]
            for k in range(len(wide)):
                white[at + k] = True
    cut = np.zeros(n, dtype=bool)
    if n > 2:
        inner = data[1:-1]
        cut[1:-1] = ((inner == 0x20) | (inner == 0x0A)) & ~white[:-2] & ~white[2:]
    filled = np.diff(offsets) > 0
    cut[offsets[1:][filled] - 1] = False   # white space that ends a row stays in its unit
    cut[offsets[:-1][filled]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes slices of a column; one per task."""

    def __init__(self, path: str, ranks: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.merges = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.token_bytes = np.zeros(max(table.values()) + 1, dtype=np.int64)
        for token, rank in table.items():
            self.token_bytes[rank] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)      # hashes of the known units, sorted
        self.place = np.zeros((0, 2), np.int64)  # first id and number of ids of each
        self.flat = np.zeros(0, np.uint32)

    @classmethod
    def default(cls) -> Encoder:
        import public_tokenizers

        return cls(vocabulary_path(), vocabulary_path(RANKS), public_tokenizers.PATTERN)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray, inner: np.ndarray) -> None:
        """Encodes units not met before. Those from the inside of a row are
        encoded in one text, as no token joins them; ids go back to their units
        by the bytes they stand for."""
        order = np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)])
        spans = list(zip(start[order].tolist(), end[order].tolist(), strict=True))
        k = int(inner.sum())
        joined = self.merges.encode_ordinary(b"".join([raw[s:e] for s, e in spans[:k]]).decode("utf-8"))
        ids = np.array(joined, dtype=np.uint32)
        size = np.cumsum(self.token_bytes[ids])
        bounds = np.searchsorted(size, np.cumsum((end - start)[order[:k]]), side="left") + 1
        counts = np.diff(bounds, prepend=0)
        alone = [self.merges.encode_ordinary(raw[s:e].decode("utf-8")) for s, e in spans[k:]]
        counts = np.concatenate([counts, [len(x) for x in alone]]).astype(np.int64)
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(alone), dtype=np.uint32)])
        place = np.stack([len(self.flat) + np.cumsum(counts) - counts, counts], axis=1)
        self.flat = np.concatenate([self.flat, ids])
        merged = np.concatenate([self.keys, keys[order]])
        by_key = np.argsort(merged, kind="stable")
        self.keys, self.place = merged[by_key], np.concatenate([self.place, place])[by_key]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and where each row's begin."""
        rows = len(offsets) - 1
        start = unit_starts(data, offsets)
        raw = data.tobytes()
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        first = np.searchsorted(start, offsets)
        end = np.append(start[1:], len(data))
        words = Words(data, start, end, np.repeat(np.arange(rows), np.diff(first)), first)
        distinct, at, back = np.unique(hash_words(words), return_index=True, return_inverse=True)
        if len(self.keys) > MEMO_UNITS:
            self._forget()
        found = np.searchsorted(self.keys, distinct)
        known = found < len(self.keys)
        known[known] = self.keys[found[known]] == distinct[known]
        if not known.all():
            edge = np.zeros(len(start), dtype=bool)
            filled = first[:-1] < first[1:]
            edge[first[:-1][filled]] = edge[first[1:][filled] - 1] = True
            new = at[~known]
            self._learn(distinct[~known], raw, start[new], end[new], ~edge[new])
            found = np.searchsorted(self.keys, distinct)
        source, size = self.place[found].T
        n = size[back]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.flat[np.arange(total[-1]) - np.repeat(total[:-1] - source[back], n)]
        bounds = total[first]
        if SPECIAL_MARK in raw:
            out, bounds = self._special(raw, offsets, out, bounds)
        return out, bounds

    def _special(self, raw, offsets, out, bounds):
        parts = []
        for r in range(len(offsets) - 1):
            text = raw[offsets[r]:offsets[r + 1]]
            parts.append(self.whole(text.decode("utf-8")) if SPECIAL_MARK in text
                         else out[bounds[r]:bounds[r + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
