"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A text's symbols form a doubly linked list; a heap holds the adjacent pairs that the vocabulary joins,
and the pair of the lowest rank (the leftmost at a tie) is joined until none is left. The count is the
number of first symbols minus the number of merges, plus what byte fallback adds for characters the
vocabulary lacks.

Merging never crosses a place where no vocabulary entry has the two neighbouring characters side by
side. Texts are cut there (before a run of spaces, around line ends), which changes no count, and the
counts of short segments are kept in a bounded memo.

Defined results: null counts as the empty text (0 bytes, 0 tokens); whole texts are counted, however
long; repeated rows give repeated rows; null ids stay null; columns besides id and text are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactframe.llm.common import map_rows

#: Segments kept with their counts by each worker, and the longest that is kept.
MEMO, MEMO_CHARS = 600_000, 48
SPACE = "▁"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffers message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            if kind == 2:
                n, i = _varint(b, i)
            else:
                n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class PieceModel:
    """Ranks and normalisation switches read from a sentencepiece BPE model file."""

    NORMAL, USER, UNUSED, BYTE = 1, 4, 5, 6

    def __init__(self, path: str):
        scored: list[tuple[float, str]] = []
        self.byte_fallback, self.dummy_prefix, self.trim, self.escape = False, True, True, True
        kinds = set()
        with open(path, "rb") as f:
            data = f.read()
        for field, value in _fields(data):
            if field == 1:
                entry = dict(_fields(value))
                kind = entry.get(3, self.NORMAL)
                kinds.add(kind)
                if kind in (self.NORMAL, self.USER, self.UNUSED):
                    scored.append((struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0, entry[1].decode()))
            elif field == 2:
                self.byte_fallback = bool(dict(_fields(value)).get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                self.dummy_prefix, self.trim, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
        if kinds & {self.USER, self.UNUSED} or self.trim or not self.escape:
            raise ValueError("only plain BPE models with identity normalisation are supported")
        order = {s: r for r, s in enumerate(sorted({s for s, _ in scored}, reverse=True))}
        self.rank = {piece: order[s] for s, piece in scored}
        self.alone = {p for p in self.rank if len(p) == 1}
        self.joined = joined = {a + b for p in self.rank for a, b in zip(p, p[1:])}
        if any(x[0] != SPACE and x[1] == SPACE for x in joined):
            raise ValueError("pieces with inner spaces are not supported")
        line = not any("\n" in x for x in joined)
        # each segment: a run of spaces and what follows it, cut around line ends where none joins them
        self.segment = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if line else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def merged_count(text: str, rank: dict[str, int]) -> int:
    """Number of merges, by a heap of adjacent pairs over a linked list.

    A heap entry is one integer: rank times length plus the left symbol's place, so that the lowest rank
    comes first and the leftmost pair at a tie. An entry is stale unless its place still starts a pair of its rank.
    """
    n = len(text)
    get = rank.get
    heap = [r * n + i for i in range(n - 1) if (r := get(text[i : i + 2])) is not None]
    if not heap:
        return 0
    symbols: list[str | None] = [*text, None]
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    merges = 0
    while heap:
        r, i = divmod(pop(heap), n)
        left = symbols[i]
        if left is None:
            continue
        j = after[i]
        right = symbols[j]
        if right is None or get(piece := left + right) != r:
            continue  # one side has been merged meanwhile
        symbols[i], symbols[j] = piece, None
        after[i] = k = after[j]
        before[k] = i
        merges += 1
        if k < n and (s := get(piece + symbols[k])) is not None:
            push(heap, s * n + i)
        if (h := before[i]) >= 0 and (s := get(symbols[h] + piece)) is not None:
            push(heap, s * n + h)
    return merges


class Counts(dict):
    """Segment -> tokens, filled on demand."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def count(self, segment: str) -> int:
        m = self.model
        joined = m.joined
        cuts = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in joined]
        if cuts:  # no merge crosses these places
            return sum(self[segment[i:j]] for i, j in zip([0, *cuts], [*cuts, len(segment)]))
        merges = merged_count(segment, m.rank)
        extra = 0
        if m.byte_fallback:
            extra = sum(len(c.encode()) - 1 for c in segment if c not in m.alone)
        return len(segment) - merges + extra

    def __missing__(self, segment: str) -> int:
        n = self.count(segment)
        if len(segment) <= MEMO_CHARS:
            self[segment] = n
        return n

    def of(self, text: str) -> int:
        if not text:
            return 0
        if len(self) > MEMO:
            self.clear()
        text = text.replace(" ", SPACE)
        if self.model.dummy_prefix:
            text = SPACE + text
        return sum(map(self.__getitem__, self.model.segment.findall(text)))


_loaded: dict[str, Counts] = {}


def counter(path: str) -> Counts:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = Counts(PieceModel(path))
    return _loaded[path]


def count_tokens(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; ``model`` is a file that every worker can open."""

    def run(parts):
        count = counter(model)
        for part in parts:
            texts = [t or "" for t in part["text"]]
            n = [count.of(t) for t in texts]
            yield {id_col: part["id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
