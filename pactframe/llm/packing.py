"""Packing documents into sequences by cutting-stock column generation.

1. A task turns each whole text into token ids, adds the end id, and cuts it into pieces of ``length`` ids and a rest. A piece's size is its length in units of
   ``length / UNITS`` ids, rounded up. It is numbered among its task's pieces of that size; pieces are written without their ids.
2. The histogram of sizes (``UNITS`` numbers at most) goes to the driver. There a linear program chooses how often to use which pattern (sizes that fill a
   sequence). It starts from patterns of one size; a knapsack dynamic program over the dual prices finds the pattern that improves it most, until
   none does, the bound of the program is within ``GAP``, or 200 steps gain less than a tenth of that.
3. Pattern counts are rounded down; the pieces left over, at most a few for each size, are packed best fit, largest first.
4. Pieces of a size are ranked, over all tasks, by adding up the tasks' counts. Patterns take ranks in intervals, so a small table of intervals tells every
   piece its sequence; no piece passes through the driver. Within a sequence pieces lie from large to small.

A sequence is padded to ``length``, unless its own length is a power of two. What is lost is the rounding of sizes, below ``length / UNITS`` ids a piece, and the last sequences.

Defined results: null and empty texts have the end id alone, whole texts count, repeated rows are packed each, null ids stay null; other columns are
ignored; an empty table gives an empty result. Special strings in a text are what the tokenizers library makes of them.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactframe.llm.common import map_rows, saved

#: Size units of a sequence; gap to the program's bound that is accepted; words a worker keeps, and the longest of them; characters tokenised at a time.
UNITS, GAP, MEMO, MEMO_CHARS, PART = 256, 1e-3, 500_000, 40, 65_536


def byte_alphabet() -> dict[int, int]:
    """How byte-level tokenizers write bytes: printable ones as themselves, the others as characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip((b for b in range(256) if b not in printable), range(256, 512)))


class Words(dict):
    """Word -> ids as bytes. Words are what the tokenizer's own pattern finds in normalised text; its model merges each by itself."""

    #: Fixed value: the pattern of this kind of tokenizer.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Characters for which normalising is lower-casing alone, and in which Unicode versions agree.
    PLAIN = "[\x00-\x1b\x20-\x7e\xa0-ɏ]*"

    def __init__(self, content: bytes):
        import json

        import regex

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        spec = json.loads(content)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        # any other kind of tokenizer gets whole texts
        self.known = steps == ["NFC", "Replace", "Lowercase"] and spec["model"].get("unk_token") is None and split.get("pattern") == {"Regex": self.PATTERN} and split.get("invert") is True
        self.find, self.plain = regex.compile(self.PATTERN).findall, regex.compile(self.PLAIN).fullmatch
        self.space = regex.compile(r"\s").search
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.merge, self.alphabet = self.tokenizer.model.tokenize, byte_alphabet()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            # words of the pattern are normalised: the merges alone are left, over the byte alphabet
            letters = word.encode().decode("latin-1").translate(self.alphabet)
            ids = array("I", [t.id for t in self.merge(letters)]).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO // 2:  # words not met again since the last turn go
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        text = text or ""
        if not self.known or not self.plain(text) or any(x in text for x in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > PART:  # words end at white space
                gap = self.space(text, at + PART)
                end = gap.start() if gap else end
            out += map(self.__getitem__, self.find(text[at:end].lower()))
            at = end
        return b"".join(out)


_loaded: dict[bytes, Words] = {}


def words_of(content: bytes) -> Words:
    key = content[:64] + zlib.crc32(content).to_bytes(4, "little")
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Words(content)
    return _loaded[key]


def pieces(docs: DataFrame, tokenizer: str, *, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, size, task, at): a row for each piece; (size, task, at) tells pieces apart."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    unit = length // UNITS
    end = array("I", [end_id]).tobytes()

    def run(parts):
        w, task, seen = words_of(sent.value), TaskContext.get().partitionId(), Counter()
        for part in parts:
            rows = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "size", "task", "at")}
            for i, text in zip(part["id"], part["text"]):
                ids = memoryview(w.ids(text) + end)
                n = len(ids) // 4
                for start in range(0, n, length):
                    own = ids[4 * start : 4 * (start + length)]
                    k = len(own) // 4
                    size = -(-k // unit)
                    for name, v in (("id", i), ("start", start), ("length", k), ("ids_crc32", zlib.crc32(own)), ("doc_tokens", n), ("size", size), ("task", task), ("at", seen[size])):
                        rows[name].append(v)
                    seen[size] += 1
            yield rows

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, size int, task int, at long")


def best_pattern(price: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern, by dynamic programming over the room used: (value, how often each size)."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    good = np.flatnonzero(price > 1e-12)
    s, p = sizes[good], price[good]
    for c in range(1, room + 1):
        value[c] = value[c - 1]
        n = int(np.searchsorted(s, c, side="right"))
        if n:
            worth = p[:n] + value[c - s[:n]]
            i = int(np.argmax(worth))
            if worth[i] > value[c]:
                value[c], choice[c] = worth[i], good[i]
    out, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            out[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(value[room]), out


def relaxed(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """The linear program: (pattern, how often), by column generation with a revised simplex step for each column."""
    n = len(sizes)
    columns = [np.where(np.arange(n) == i, room // sizes[i], 0) for i in range(n)]  # one size each
    cost = np.ones(n)
    inverse = np.diag([1.0 / c[i] for i, c in enumerate(columns)])
    x = demand / np.array([c[i] for i, c in enumerate(columns)], float)
    bound, last = 0.0, np.inf
    for step in range(50 * n + 50):
        if step % 200 == 199:  # rounding errors of the updates go
            inverse = np.linalg.inv(np.stack(columns, axis=1).astype(float))
            x = np.maximum(0, inverse @ demand)
            if float(cost @ x) > last * (1 - gap / 10):  # steps without gain
                break
            last = float(cost @ x)
        price = cost @ inverse
        low = int(np.argmin(price))
        if price[low] < -1e-9:  # more pieces than there are may be worth having room for
            new, its_cost = -np.eye(n, dtype=np.int64)[low], 0.0
        else:
            value, new = best_pattern(price, sizes, room)
            its_cost, total = 1.0, float(cost @ x)
            bound = max(bound, total / max(value, 1.0))  # no solution uses fewer sequences
            if value <= 1 + 1e-9 or total <= bound * (1 + gap):
                break
        way = inverse @ new
        rises = np.flatnonzero(way > 1e-10)
        if not len(rises):
            break
        ratio = x[rises] / way[rises]
        out = int(rises[np.argmin(ratio)])
        t = float(x[out] / way[out])
        x -= t * way
        x[out] = t
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        columns[out], cost[out] = new, its_cost
        np.maximum(x, 0, out=x)
    return [(c, float(v)) for c, v, k in zip(columns, x, cost) if k and v > 0]


def plan(histogram: dict[int, int], room: int = UNITS) -> list[tuple[dict[int, int], int]]:
    """Patterns {size: how often} with how many sequences use them; together they hold every piece of the histogram."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    out = []
    for pattern, times in sorted(relaxed(sizes, left.astype(float), room), key=lambda r: -r[1]):
        fits = min((int(left[i] // pattern[i]) for i in np.flatnonzero(pattern)), default=0)
        k = min(int(times + 1e-6), fits)
        if k:
            out.append(({int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}, k))
            left -= k * pattern
    # what rounding leaves: each piece goes where it leaves the least room, largest first
    open_ones: dict[int, list[Counter]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        s = int(sizes[i])
        alone = int(left[i]) if 2 * s > room and not open_ones and i == len(sizes) - 1 and s == room else 0
        if alone:
            out.append(({s: 1}, alone))
        for _ in range(int(left[i]) - alone):
            rest = min((r for r, own in open_ones.items() if own and r >= s), default=None)
            own = open_ones[rest].pop() if rest is not None else Counter()
            own[s] += 1
            open_ones.setdefault((room if rest is None else rest) - s, []).append(own)
    same = Counter(tuple(sorted(own.items())) for many in open_ones.values() for own in many)
    return out + [(dict(p), k) for p, k in same.items()]


def intervals(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, rank after the last, pieces of the size in a sequence, first sequence) of each pattern and size."""
    rank, sequence, out = Counter(), 0, []
    for pattern, times in patterns:
        for s, k in pattern.items():
            out.append((s, rank[s], rank[s] + k * times, k, sequence))
            rank[s] += k * times
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str, *, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece. ``tokenizer`` is a path of the driver, ``length`` a multiple of ``UNITS``."""
    if length % UNITS:
        raise ValueError(f"length must be a multiple of {UNITS}")
    spark = docs.sparkSession
    cut = saved(pieces(docs, tokenizer, length=length, end_id=end_id, id_col=id_col, text_col=text_col))
    counts = cut.groupBy("size", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = saved(counts.select("size", "task", "n", F.coalesce(before, F.lit(0)).alias("before")))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    # a row for each size of a pattern; there are at most two patterns a size
    places = spark.createDataFrame(intervals(plan(histogram)), "of int, first long, last long, k long, base long")
    ranked = cut.join(counts.drop("n"), ["size", "task"]).withColumn("rank", F.col("before") + F.col("at"))
    placed = ranked.join(F.broadcast(places), (F.col("size") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    placed = placed.withColumn("sequence_id", (F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("k"))).cast("long"))
    # a sequence has at most ``length`` pieces
    w = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(w), F.lit(0))
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
