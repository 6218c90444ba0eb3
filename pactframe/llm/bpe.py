"""Byte-level BPE by a lazily determinised finite-state transducer, and a streaming decoder.

Encoding. The last token of each prefix's encoding is the one vocabulary entry that ends the prefix and may follow the
last token of what stands before it; two tokens may follow one another if merging their bytes by rank gives them back.
A transducer state is all that later bytes can depend on: the longest suffix that starts an entry (a node of the entries'
trie), and the last token of the prefix before each place in it from which an entry may still start. What was read before has no part
in it, so pieces share states. States and edges are made when first met and kept: a known byte costs one look-up and tells the last
token so far. Tokens are emitted once every way to go on passes through their end; that place lies no further back than
the bounded suffix, so the lookahead is bounded, and of a long piece no more than ``WINDOW`` bytes are held.

Decoding. Tokens are joined in chunks; a UTF-8 state machine runs over the last bytes of each chunk and holds an
unfinished character back for the next one.

Pieces are the matches of the library's pattern. A piece that is an entry itself is that token, as in the library.
A worker keeps at most ``STATES`` states (once so many are known, further ones are made, used and forgotten) and ``MEMO`` pieces.

Defined results: null and empty texts have no tokens; whole texts count, however long; repeated rows give repeated
rows; null ids stay null; other columns are ignored; empty tables give an empty result. Ids outside the vocabulary decode to no bytes;
bytes that aren't UTF-8 (never those of a text's own ids) become U+FFFD in decoded text, but are hashed as they are.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactframe.llm.common import map_rows

#: States, pairs of tokens and pieces a worker keeps; the longest piece that is kept; bytes of a piece held; tokens decoded at a time.
STATES, FOLLOW, MEMO, MEMO_CHARS, WINDOW, CHUNK = 400_000, 1_000_000, 500_000, 48, 1_024, 4_096


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], border: int = 0) -> list[bytes]:
    """Plain merging by rank, the leftmost pair first at a tie. With a ``border`` it stops at a merge across that place."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 256
    pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i] += parts.pop(i + 1)
        if border and sum(map(len, parts[:i])) < border < sum(map(len, parts[: i + 1])):
            break
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return parts


class State(dict):
    """Edges by byte. ``node``: the suffix; ``back``: (bytes from a starting place to here, last token before it), longest first,
    ending with this place itself; ``last``: that place's last token."""

    __slots__ = ("back", "last", "node")


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        missing = [x for x in range(256) if bytes([x]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.size = {i: len(b) for b, i in ranks.items()}
        # trie over entries: every prefix of an entry is a node
        self.prefixes = {b[:i] for b in ranks for i in range(1, len(b) + 1)}
        self.follow: dict[tuple[int | None, int], bool] = {}
        self.states: dict[tuple, State] = {}
        self.start = self.state(b"", ((0, None),))

    def state(self, node: bytes, back: tuple) -> State:
        key = (node, back)
        s = self.states.get(key)
        if s is None:
            s = State()
            s.node, s.back, s.last = node, back, back[-1][1]
            if len(self.states) < STATES:
                self.states[key] = s
        return s

    def may_follow(self, a: int | None, b: int) -> bool:
        ok = self.follow.get((a, b))
        if ok is None:
            y = self.bytes_of[b]
            x = b"" if a is None else self.bytes_of[a]
            ok = merge(x + y, self.ranks, len(x)) == ([x, y] if x else [y])
            if len(self.follow) < FOLLOW:
                self.follow[a, b] = ok
        return ok

    def step(self, s: State, byte: int) -> State:
        """Make the edge of ``s`` for ``byte``."""
        window = s.node + bytes((byte,))
        n = len(window)
        last, kept = None, []
        for size, before in s.back:
            entry = window[n - size - 1 :]
            if entry in self.prefixes:
                kept.append((size + 1, before))
                if last is None:
                    t = self.ranks.get(entry)
                    if t is not None and self.may_follow(before, t):
                        last = t
            elif last is None and entry in self.ranks:
                raise AssertionError("an entry isn't its own prefix")
        if last is None:
            raise AssertionError("a prefix has no encoding")
        made = self.state(window[n - kept[0][0] :] if kept else b"", (*kept, (0, last)))
        if len(self.states) < STATES:
            s[byte] = made
        return made

    def settled(self, path: list[State]) -> int:
        """The last place that all ways to go on pass through."""
        n, common = len(path), None
        for size, _ in path[-1].back:
            p, chain = n - size, set()
            while p > 0:
                chain.add(p)
                p -= self.size[path[p - 1].last]
            common = chain if common is None else common & chain
        return max(common, default=0)

    def tokens(self, path: list[State], end: int) -> list[int]:
        """Of the way that ends at a place."""
        out = []
        while end > 0:
            t = path[end - 1].last
            out.append(t)
            end -= self.size[t]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        s, path, out = self.start, [], []
        for byte in piece:
            s = s.get(byte) or self.step(s, byte)
            path.append(s)
            if len(path) == WINDOW:
                at = self.settled(path)
                out += self.tokens(path, at)
                del path[:at]
        return out + self.tokens(path, len(path)) if out else self.tokens(path, len(path))


class Utf8:
    """Incremental UTF-8: gives text up to the last finished character and holds the rest."""

    # classes of bytes: ASCII, continuation in three ranges, lead bytes by what may follow
    KIND = np.zeros(256, np.uint8)
    for _lo, _hi, _k in ((0x80, 0x8F, 1), (0x90, 0x9F, 2), (0xA0, 0xBF, 3), (0xC0, 0xC1, 11), (0xC2, 0xDF, 4), (0xE0, 0xE0, 5), (0xE1, 0xEC, 6), (0xED, 0xED, 7), (0xEE, 0xEF, 6), (0xF0, 0xF0, 8), (0xF1, 0xF3, 9), (0xF4, 0xF4, 10), (0xF5, 0xFF, 11)):
        KIND[_lo : _hi + 1] = _k
    KIND = KIND.tolist()
    #: state -> class -> state; 0 accepts, -1 is an error, 1 to 3 want as many bytes, 4 to 7 restrict the next.
    MOVES = [[-1] * 12 for _ in range(8)]
    MOVES[0] = [0, -1, -1, -1, 1, 4, 2, 5, 6, 3, 7, -1]
    for _s, _to, _kinds in ((1, 0, (1, 2, 3)), (2, 1, (1, 2, 3)), (3, 2, (1, 2, 3)), (4, 1, (3,)), (5, 1, (1, 2)), (6, 2, (2, 3)), (7, 2, (1,))):
        for _k in _kinds:
            MOVES[_s][_k] = _to

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for at in range(len(data) - 1, max(-1, len(data) - 4), -1):
            if self.KIND[data[at]] in (1, 2, 3):
                continue
            state = 0
            for byte in data[at:]:
                state = self.MOVES[state][self.KIND[byte]]
                if state < 0:
                    break
            if state > 0:
                cut = at
            break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Codec(dict):
    """Piece of text -> its ids as little-endian 32-bit integers, filled on demand."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        super().__init__()
        self.fst = Transducer(read_ranks(ranks))
        self.find = regex.compile(pattern).findall
        self.vocab = [self.fst.bytes_of.get(i, b"") for i in range(max(self.fst.bytes_of, default=-1) + 1)]
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "replace")
            ids = array("I", self.fst.encode(data)).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO // 2:  # pieces not met again since the last turn go
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text or "")))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        n = len(self.vocab)
        return b"".join([self.vocab[i] if 0 <= i < n else b"" for i in ids])

    def stream(self, ids: bytes, chunk: int = CHUNK) -> Iterator[tuple[bytes, str]]:
        """Bytes of each ``chunk`` ids, and the text that is certain with them."""
        machine, all_ids = Utf8(), array("I", ids)
        for i in range(0, len(all_ids), chunk):
            data = self.decode_bytes(all_ids[i : i + chunk])
            yield data, machine.feed(data)
        yield b"", machine.close()

    def decode(self, ids: Iterable[int], chunk: int = CHUNK) -> Iterator[str]:
        """Text as it becomes certain."""
        return (text for _, text in self.stream(array("I", ids).tobytes(), chunk))


_loaded: dict[tuple[bytes, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(ranks).digest(), pattern
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Codec(ranks, pattern)
    return _loaded[key]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids binary, decoded string]) of each row. ``ranks`` is a path of the driver; its
    content, a vocabulary's, goes to the executors."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(ranks).read_bytes())

    def run(parts):
        c = codec(sent.value, pattern)
        for part in parts:
            out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for text in part["text"]:
                ids = c.encode(text)
                sha, texts = hashlib.sha256(), []
                for data, piece in c.stream(ids):
                    sha.update(data)
                    if with_ids:
                        texts.append(piece)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(sha.hexdigest())
                if with_ids:
                    out["ids"].append(ids)
                    out["decoded"].append("".join(texts))
            yield {id_col: part["id"], **out}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    more = ", ids binary, decoded string" if with_ids else ""
    return map_rows(rows, run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
