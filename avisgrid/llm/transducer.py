"""Token counts by a finite-state transducer compiled from a BPE file.

A symbol is a byte, or a byte that ends a word. The state after a prefix of a word holds, for
every place where a longer token may still begin, the token before that place and how many
tokens lie after it. The next symbol decides the prefix's last token: the one vocabulary
token that ends here and is a valid neighbour of the token before it (a token sequence is
the merge rules' result exactly if all its neighbours are). The transition carries the change
of the token count; a word's last symbol leads back to the start. States are compiled as
texts reach them and dropped together when there are ``STATES`` of them.

Texts run in chunks of ``CHUNK`` symbols side by side. Behind its first word end a chunk's state map is
constant, whatever state it is entered in; the scan hands every chunk's exit state to the symbols
before the next one's first word end (for chunks inside one long word, one after the other), and a
prefix sum of the emitted counts gives those of all texts.

Null counts as empty: no tokens. Special strings count as one token each. Repeated rows stay,
a null id is carried, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from avisgrid.llm import textblocks as tb
from avisgrid.llm.bytepairs import split_contractions

LIMIT = 2048
STATES = 200_000
ROWS = 1 << 14  # states and columns are added to the tables in these steps
COLUMNS = 16
PAIRS = 400_000  # neighbour tests remembered
CHUNK = 256
END = 256  # added to the byte that ends a word
_WORD_END = "</w>"
_NONE = -1

_Entry = tuple[int, int, int]  # trie node, token before, tokens since


class Compiler:
    """States and transitions of a word-end BPE file, made when they are first reached."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

        def symbols(token: str) -> tuple[int, ...]:
            ends = token.endswith(_WORD_END) and token != _WORD_END
            body = [byte_of[c] for c in (token.removesuffix(_WORD_END) if ends else token)]
            return (*body[:-1], body[-1] + END * ends)

        vocabulary = model["vocab"]
        self.symbols = {i: symbols(t) for t, i in vocabulary.items()}
        self.single = {s[0]: i for i, s in self.symbols.items() if len(s) == 1}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault(
                (vocabulary[left], vocabulary[right]), (rank, vocabulary[left + right])
            )
        self.children: list[dict[int, int]] = [{}]
        self.token = [_NONE]
        for i, s in self.symbols.items():
            if self.merged(s) == [i]:  # tokens that no text can give are left out
                node = 0
                for x in s:
                    if x not in self.children[node]:
                        self.children[node][x] = len(self.children)
                        self.children.append({})
                        self.token.append(_NONE)
                    node = self.children[node][x]
                self.token[node] = i
        self.reset()

    def reset(self) -> None:
        self.entries: list[tuple[_Entry, ...]] = [((0, _NONE, 0),)]
        self.number = {self.entries[0]: 0}
        self.columns = np.full(2 * END, _NONE, np.int32)  # of the symbols met so far
        self.n_columns = 0
        self.next = np.full((ROWS, COLUMNS), _NONE, np.int32)
        self.emit = np.zeros((ROWS, COLUMNS), np.int8)
        self.valid: dict[tuple[int, int], bool] = {}

    def merged(self, symbols: tuple[int, ...]) -> list[int]:
        """The merge rules applied to symbols."""
        ids = [self.single[x] for x in symbols]
        while len(ids) > 1:
            found = [(self.merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
            if not found:
                break
            _, k = min(found)
            ids[k : k + 2] = [self.merge[ids[k], ids[k + 1]][1]]
        return ids

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the merge rules leave the two tokens side by side."""
        known = self.valid.get((a, b))
        if known is None:
            if len(self.valid) >= PAIRS:
                self.valid.clear()
            known = self.merged(self.symbols[a] + self.symbols[b]) == [a, b]
            self.valid[a, b] = known
        return known

    def _follow(self, entries: tuple[_Entry, ...], x: int) -> tuple[tuple[_Entry, ...], int]:
        """State after a symbol, and the change of the token count."""
        reached = [
            (self.children[node][x], before, since)
            for node, before, since in entries
            if x in self.children[node]
        ]
        for node, before, since in reached:  # longest first; exactly one fits
            last = self.token[node]
            if last != _NONE and (before == _NONE or self.neighbours(before, last)):
                change = 1 - since
                break
        if x >= END:
            return self.entries[0], change
        going = [(n, b, s + change) for n, b, s in reached if self.children[n]]
        return (*going, (0, last, 0)), change

    def _column(self, x: int) -> int:
        if self.columns[x] == _NONE:
            if self.n_columns == self.next.shape[1]:
                wider = ((0, 0), (0, COLUMNS))
                self.next = np.pad(self.next, wider, constant_values=_NONE)
                self.emit = np.pad(self.emit, wider)
            self.columns[x] = self.n_columns
            self.n_columns += 1
        return int(self.columns[x])

    def learn(self, state: int, x: int) -> None:
        entries, change = self._follow(self.entries[state], x)
        target = self.number.setdefault(entries, len(self.entries))
        if target == len(self.entries):
            self.entries.append(entries)
            if target == len(self.next):
                longer = ((0, ROWS), (0, 0))
                self.next = np.pad(self.next, longer, constant_values=_NONE)
                self.emit = np.pad(self.emit, longer)
        column = self._column(x)
        self.next[state, column], self.emit[state, column] = target, change

    def step(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted counts of many runs at once."""
        column = self.columns[x]
        target = np.where(column >= 0, self.next[state, column], _NONE)
        missing = np.flatnonzero(target < 0)
        if len(missing):
            for pair in np.unique(state[missing].astype(np.int64) * 2 * END + x[missing]).tolist():
                self.learn(*divmod(pair, 2 * END))
            column = self.columns[x]
            target = self.next[state, column]
        return target, self.emit[state, column]

    def counts(self, symbols: np.ndarray) -> np.ndarray:
        """Emitted count at every symbol; the last symbol must end a word."""
        if len(self.entries) > STATES:
            self.reset()
        n = len(symbols)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, END, np.int64)
        grid[:n] = symbols
        grid = grid.reshape(chunks, CHUNK)
        ends = grid >= END
        whole = ends.any(1)
        head = np.where(whole, ends.argmax(1) + 1, CHUNK)  # symbols that depend on the entry
        out = np.zeros((chunks, CHUNK), np.int8)
        leaving = np.zeros(chunks, np.int64)
        # Behind the heads every chunk runs from the start state.
        for c in range(CHUNK):
            on = np.flatnonzero(head <= c)
            if len(on):
                leaving[on], out[on, c] = self.step(leaving[on], grid[on, c])
        # Scan: the first chunk of every stretch is entered in a known state.
        known = np.concatenate([[True], whole[:-1]])
        entering = np.concatenate([[0], leaving[:-1]])
        ready = np.flatnonzero(known)
        while len(ready):
            state = entering[ready]
            for c in range(int(head[ready].max())):
                on = np.flatnonzero(head[ready] > c)
                state[on], out[ready[on], c] = self.step(state[on], grid[ready[on], c])
            # A chunk inside one long word hands its state on.
            through = np.flatnonzero(~whole[ready] & (ready + 1 < chunks))
            entering[ready[through] + 1] = state[through]
            ready = ready[through] + 1
        return out.reshape(-1)[:n]


_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 4


class Counter:
    """Token counts of texts under a tokenizer file with word ends."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.compiler = Compiler(path)
        self.kinds = np.zeros(0x110000, np.uint8)
        self.lower = np.zeros(0x110000, np.uint32)  # 0: not looked up, 1: needs the normalizer

    def _kind(self, c: str) -> int:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        if not split(c):
            return _SPACE
        if len(split("a" + c)) == 1:
            return _LETTER
        return _NUMBER if len(split(c + c)) == 2 else _OTHER

    def _look_up(self, points: np.ndarray) -> None:
        for p in np.unique(points[self.lower[points] == 0]).tolist():
            low = self.tokenizer.normalizer.normalize_str(chr(p))
            self.lower[p] = ord(low) if len(low) == 1 and ord(low) > 1 else 1
            self.kinds[p] = self._kind(chr(p))

    def _normal(self, text: str) -> str:
        """One text under the tokenizer's own normalizer."""
        return self.tokenizer.normalizer.normalize_str(text)

    def _prepared(self, raw: bytes, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """Normalized text, code points, offsets, and special strings of every text."""
        special = np.zeros(len(offsets) - 1, np.int64)
        text, points, at = tb.code_points(raw, offsets)
        self._look_up(points)
        low = self.lower[points]
        plain = not any(s in text for s in self.special)
        if not (plain and low.all() and (low != 1).all() and unicodedata.is_normalized("NFC", text)):
            texts = []
            for k in range(len(offsets) - 1):
                own = text[at[k] : at[k + 1]]
                for s in self.special:
                    special[k] += own.count(s)
                    own = own.replace(s, "\n")
                texts.append(self._normal(own))
            at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            text = "".join(texts)
            low = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            self._look_up(low)
        else:
            text = low.astype("<u4").tobytes().decode("utf-32-le")
        return text, low, at, special

    def counts(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every text."""
        text, points, offsets, total = self._prepared(raw, offsets)
        n = len(points)
        if not n:
            return total
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        kind = self.kinds[points]
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        start |= edge[:n]
        split_contractions(text, points, kind == _LETTER, start, edge)
        last = np.append(start[1:], True)  # code points that end a word
        octets = np.frombuffer(text.encode("utf-8"), np.uint8).astype(np.int64)
        if len(octets) == n:
            of = np.arange(n)
        else:
            size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            of = np.repeat(np.arange(n), size)
        final = np.append(of[1:] != of[:-1], True) & last[of]
        kept = kind[of] != _SPACE
        symbols = (octets + END * final)[kept]
        if not len(symbols):
            return total
        emitted = np.concatenate([[0], np.cumsum(self.compiler.counts(symbols), dtype=np.int64)])
        bounds = np.searchsorted(of[kept], offsets)
        return total + emitted[bounds[1:]] - emitted[bounds[:-1]]


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """The worker's own counter: compiled states last from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every document."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for lo, hi, raw, offsets in tb.blocks(batch, "text"):
                n = counter.counts(raw, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(offsets)),
                        pa.array(n),
                        pa.array(n > limit),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
