"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE`` bytes, cut at white space. Every passage of the whole text is encoded: shares of hashed
byte pairs and a few statistics, then a dense layer, h = relu(E x + e). Gated attention weighs the passages,
a = softmax(w . (tanh(V h) * sigmoid(U h))), and the document's score is sigmoid(c . sum(a h) + b). All of it is learned together from
document labels alone.

The fit runs on the driver over a bounded sample: at most ``sample`` labelled documents (those of the smallest hashed ids), with
every passage of each. Executors encode the sample; the driver takes it partition by partition into a file of its own temp folder, as rows of ``WIDTH``
half-width numbers, and reads batches from there; a batch of many passages goes through in parts of ``PART`` passages or one document. Scoring covers every passage of every document, in blocks with a running softmax: besides a block, a few bytes for each byte of the text are held (its bytes, their classes, and windows at word beginnings).

Defined results: null and empty texts are one empty passage and get a score like any other; null labels don't count; an id with several labels
is good if one is; without labels of both kinds the score is the share of good ones (1/2 without any). Ids, sources, languages and labels are no
input of a score. Rows that repeat are scored each; other columns are ignored or kept as they are; empty tables give empty results.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactframe.llm.common import extend, fresh_name, importable, map_rows

PASSAGE, PAIRS, STATS = 512, 256, 12
WIDTH = PAIRS + STATS
SAMPLE, BLOCK, PART = 6_000, 1_024, 16_384
HIDDEN, GATE, EPOCHS, RATE, BATCH = 32, 16, 12, 3e-3, 64

# fixed byte classes: upper case, lower case, digit, symbol, sentence mark, other punctuation, white space, beyond ASCII
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 0
_CLASS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASS[[*b"0123456789"]] = 2
_CLASS[[*b"#*$%&|<>"]] = 3
_CLASS[[*b".,;:?"]] = 4
_CLASS[[*b" \t\n\r\x0b\x0c"]] = 6
_CLASS[128:] = 7


def borders(data: np.ndarray) -> np.ndarray:
    """Where passages begin, and the end: each at the first white space from its 512 bytes on, twice that without any."""
    n = len(data)
    if n <= PASSAGE * 3 // 2:
        return np.array([0, n])
    space = np.flatnonzero(_CLASS[data] == 6)
    cuts = np.arange(PASSAGE, n - PASSAGE // 2, PASSAGE)
    at = np.searchsorted(space, cuts)
    near = space[np.minimum(at, len(space) - 1)] if len(space) else np.full(len(cuts), -1)
    cuts = np.where((at < len(space)) & (near - cuts < PASSAGE // 2), near, cuts)
    return np.concatenate([[0], cuts, [n]])


def encoded(text: str | None, block: int = BLOCK) -> Iterator[np.ndarray]:
    """A row for each passage, ``block`` of them at a time."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    edge = borders(data)
    p, n = len(edge) - 1, len(data)
    if not n:
        yield np.zeros((p, WIDTH), np.float32)
        return
    kind = _CLASS[data]
    # repetition: of windows of 16 bytes at the beginnings of words, those seen before in the text
    starts = np.flatnonzero((kind[1:] != 6) & (kind[:-1] == 6)) + 1
    starts = starts[starts + 16 <= n]
    seen, begun = np.zeros(p), np.zeros(p)
    if len(starts):
        wide = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 16)[starts]).view(np.uint64)
        keys = wide[:, 0] * np.uint64(0x9E3779B97F4A7C15) + wide[:, 1]
        again = np.ones(len(keys))
        again[np.unique(keys, return_index=True)[1]] = 0
        place = np.searchsorted(edge, starts, side="right") - 1
        begun = np.bincount(place, minlength=p).astype(float)
        seen = np.bincount(place, weights=again, minlength=p) / np.maximum(1, begun)
    for first in range(0, p, block):
        own = edge[first : first + block + 1]
        m, low, high = len(own) - 1, int(own[0]), int(own[-1])
        size = np.diff(own).astype(np.float32)
        of = np.repeat(np.arange(m), np.diff(own))
        out = np.zeros((m, WIDTH), np.float32)
        # a pair belongs to the passage of its second byte
        before = data[max(0, low - 1) : high].astype(np.int64)
        pair = (before[:-1] * 31 + before[1:] * 7) % PAIRS
        out[:, :PAIRS] = 16 * np.sqrt(np.bincount(of[len(of) - len(pair) :] * PAIRS + pair, minlength=m * PAIRS).reshape(m, PAIRS) / size[:, None])
        shares = np.bincount(of * 8 + kind[low:high], minlength=m * 8).reshape(m, 8) / size[:, None]
        out[:, PAIRS : PAIRS + 8] = 4 * shares
        out[:, PAIRS + 8] = 4 * seen[first : first + m]
        out[:, PAIRS + 9] = 8 * begun[first : first + m] / size
        out[:, PAIRS + 10] = np.log1p(size) / 4
        out[:, PAIRS + 11] = np.log1p(n) / 8
        yield out


def encode(text: str | None) -> np.ndarray:
    """A row for each passage."""
    return np.concatenate(list(encoded(text)))


class Attention:
    """The model; ``parts`` are numpy arrays, so that it travels to workers as it is."""

    def __init__(self, rng: np.random.Generator, prior: float):
        def draw(a, b):
            return rng.normal(0, np.sqrt(1 / a), (a, b)).astype(np.float32)

        self.prior = prior
        self.mean, self.spread = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.parts = {"E": draw(WIDTH, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE, 1)[:, 0], "c": np.zeros(HIDDEN, np.float32), "b": np.array(np.log(prior / (1 - prior)), np.float32)}

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.parts
        x = (x - self.mean) / self.spread
        h = np.maximum(0, x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        return x, h, t, g, (t * g) @ p["w"]

    def score(self, text: str | None) -> float:
        top, mass, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for rows in encoded(text):
            _, h, _, _, a = self.passages(rows)
            new = max(top, float(a.max()))
            w = np.exp(a.astype(np.float64) - new)
            fade = np.exp(top - new)
            z, mass, top = z * fade + w @ h, mass * fade + w.sum(), new
        return float(1 / (1 + np.exp(-np.clip(self.parts["c"] @ (z / mass) + self.parts["b"], -30, 30))))

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over bags; rows of a bag are adjacent."""
        p, n = self.parts, len(y)
        x, h, t, g, a = self.passages(x)
        first = np.flatnonzero(np.diff(bag, prepend=-1))
        a = np.exp(a - np.maximum.reduceat(a, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        d = (1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30))) - y) / n
        dz = (d[:, None] * p["c"])[bag]
        da = (dz * h).sum(1)
        da = a * (da - np.add.reduceat(a * da, first)[bag])
        dt, dg = da[:, None] * p["w"] * g * (1 - t * t), da[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (h > 0)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ d, "b": d.sum()}


def batch_gradients(model: Attention, bags: list[np.ndarray], y: np.ndarray, pick: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss over the picked bags, in parts of ``PART`` rows or one bag."""
    size = np.array([len(bags[j]) for j in pick])
    part = np.zeros(len(pick), np.int64)
    rows = 0
    for i in range(len(pick)):
        new = i > 0 and rows + size[i] > PART
        rows = size[i] if new else rows + size[i]
        part[i] = (part[i - 1] if i else 0) + new
    out: dict[str, np.ndarray] = {}
    for k in range(part[-1] + 1):
        own = np.flatnonzero(part == k)
        x = np.concatenate([bags[j] for j in pick[own]]).astype(np.float32)
        got = model.gradients(x, np.repeat(np.arange(len(own)), size[own]), y[pick[own]].astype(np.float32))
        share = np.float32(len(own) / len(pick))
        out = {n: v * share + out.get(n, 0) for n, v in got.items()}
    return out


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Attention:
    """Adam over shuffled batches."""
    prior = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < prior < 1:
        model = Attention(np.random.default_rng(seed), 0.5)
        model.parts["b"] = np.array(0.0 if not len(y) else (20.0 if prior else -20.0), np.float32)
        return model
    rng = np.random.default_rng(seed)
    model = Attention(rng, prior)
    rows = sum(map(len, bags))
    mean = sum(b.sum(0, dtype=np.float64) for b in bags) / rows
    spread = np.sqrt(sum(((b - mean) ** 2).sum(0) for b in bags) / rows) + 0.05
    model.mean, model.spread = mean.astype(np.float32), spread.astype(np.float32)
    m1 = {k: np.zeros_like(v) for k, v in model.parts.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.parts.items()}
    step, n = 0, len(bags)
    total = EPOCHS * -(-n // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            pick = order[i : i + BATCH]
            step += 1
            rate = RATE * (1 - 0.95 * step / total)
            for k, v in batch_gradients(model, bags, y, pick).items():
                if k in "EVUc":
                    v = v + 1e-4 * model.parts[k]
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                model.parts[k] = (model.parts[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, wanted: Column | None = None) -> Attention:
    """Learn from at most ``sample`` labelled documents; ``wanted`` (over the column ``id``) says which ids may be learned from."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) == 1).cast("int").alias("y"))
    if wanted is not None:
        known = known.filter(wanted)
    ids = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(parts):
        for part in parts:
            yield {"id": part["id"], "y": part["y"], "x": [encode(t).astype(np.float16).tobytes() for t in part["text"]]}

    # the sample is bounded, and so is its broadcast; of rows that repeat an id one is learned from
    found = map_rows(rows.join(F.broadcast(ids), "id"), run, f"id {dict(ids.dtypes)['id']}, y int, x binary").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    with tempfile.TemporaryFile() as file:
        known, at = [], 0  # (id, label, first row, rows)
        for r in found.toLocalIterator():
            file.write(r.x)
            n = len(r.x) // (2 * WIDTH)
            known.append((r.id, r.y, at, n))
            at += n
        file.flush()
        known.sort(key=lambda r: r[0])
        data = np.memmap(file, np.float16, "r", shape=(at, WIDTH)) if at else np.zeros((0, WIDTH), np.float16)
        return train([data[first : first + n] for _, _, first, n in known], np.array([r[1] for r in known], np.int64))


def scored(docs: DataFrame, model: Attention, text_col: str, name: str) -> DataFrame:
    """``docs`` and a struct ``name`` with the score."""
    importable(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return extend(docs, text_col, lambda texts: [{"score": sent.value.score(t)} for t in texts], "score double", name)


def held_out(id_col: Column) -> Column:
    """Ids kept from learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) of each row."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample, wanted=~held_out(F.col("id")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    s = scored(rows, model, "text", "s").select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("s.score").alias("score"))
    return s.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", cutoff: float = 0.7, **params) -> DataFrame:
    """The rows of ``docs`` with a score of ``cutoff`` at least, with their columns as they are."""
    model = fit(docs, labels, text_col=text_col, wanted=~held_out(F.col("id")), **params)
    name = fresh_name(docs, "__scored")
    return scored(docs, model, text_col, name).filter(F.col(f"{name}.score") >= cutoff).drop(name)
