"""Token ids of a byte-level vocabulary, one merge per distinct piece instead of per text.

The pre-tokenizer's pieces are found for whole blocks with array operations; only pieces
not seen before are merged, their ids are kept by hash. Character classes come from the
tokenizer file's own pre-tokenizer, the special string from its added tokens.
"""

from __future__ import annotations

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from avisgrid.llm import textblocks as tb

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
CACHED_PIECES = 300_000
_TAILS = ("s", "t", "re", "ve", "m", "ll", "d")  # after an apostrophe, a piece of their own


def split_contractions(
    text: str, points: np.ndarray, letter: np.ndarray, start: np.ndarray, edge: np.ndarray
) -> None:
    """Make pieces of an apostrophe that opens one and the tail after it; changes ``start``."""
    n = len(points)
    if n < 2:
        return
    opens = (points[:-1] == 39) & start[:-1] & letter[1:] & ~edge[1:n]
    for i in np.flatnonzero(opens).tolist():
        for tail in _TAILS:
            end = i + 1 + len(tail)
            if text.startswith(tail, i + 1) and not edge[i + 1 : end].any():
                start[i + 1] = False
                if end < n:
                    start[end] = True
                break


class PieceIds:
    """Ids of texts under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.kinds = np.zeros(0x110000, np.uint8)
        self.bpe = self._merger(path)
        self.reset()

    @staticmethod
    def _merger(path: str) -> tiktoken.Encoding:
        """The file's vocabulary as ranks: its ids follow the order of its merges."""
        import json

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
        return tiktoken.Encoding(
            "pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
        )

    def reset(self) -> None:
        self.row: dict[int, int] = {}
        self.begin = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _kind(self, c: str) -> int:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for kind, like in ((LETTER, "a"), (NUMBER, "0"), (OTHER, "!")):
            if len(split(like + c)) == 1:
                return kind
        return SPACE

    def _classes(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if not kinds.all():
            for p in np.unique(points[kinds == 0]).tolist():
                self.kinds[p] = self._kind(chr(p))
            kinds = self.kinds[points]
        return kinds

    def pieces(self, text: str, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokenizer's pieces; special strings are pieces of their own."""
        n = len(points)
        edge = np.zeros(n + 1, bool)  # no piece crosses an edge
        edge[offsets] = True
        inside = []
        for special in self.special:
            at = text.find(special)
            while at >= 0:
                end = at + len(special)
                if not edge[at + 1 : end].any():
                    edge[at] = edge[end] = True
                    inside.append((at, end))
                at = text.find(special, end)
        kind = self._classes(points)
        space = kind == SPACE
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        # The last blank before a visible character stands alone; a plain space joins it.
        before = np.zeros(n, bool)
        before[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
        at = np.flatnonzero(before)
        start[at] = True
        start[at + 1] = points[at] != 32
        start |= edge[:n]
        split_contractions(text, points, kind == LETTER, start, edge)
        for a, b in inside:
            start[a + 1 : b] = False
        return np.flatnonzero(start)

    def _learn(self, piece: str) -> int:
        ids = [self.special[piece]] if piece in self.special else self.bpe.encode_ordinary(piece)
        row = len(self.row)
        if row == len(self.begin):
            self.begin, self.length = np.resize(self.begin, 2 * row), np.resize(self.length, 2 * row)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.begin[row], self.length[row] = self.used, len(ids)
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return row

    def encode(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        text, points, offsets = tb.code_points(raw, offsets)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.row) > CACHED_PIECES:
            self.reset()
        starts = self.pieces(text, points, offsets)
        stops = np.append(starts[1:], len(points))
        distinct, first, inverse = np.unique(
            tb.span_hashes(points, starts, stops), return_index=True, return_inverse=True
        )
        rows = [self.row.get(h, -1) for h in distinct.tolist()]
        for k, row in enumerate(rows):
            if row < 0:
                i = first[k]
                rows[k] = self._learn(text[starts[i] : stops[i]])
                self.row[int(distinct[k])] = rows[k]
        row = np.array(rows, np.int64)[inverse]
        length = self.length[row]
        ids = self.pool[tb.gathered(self.begin[row], length)]
        done = np.concatenate([[0], np.cumsum(length)])
        return ids, done[np.searchsorted(starts, offsets)]
