"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

1. A task turns each text into its set of word shingles (as sorted 64-bit hashes), takes the minima of k
   permutations of it, hashes every r of them to a band key, and keeps only the lowest b = 2 bits of each minimum,
   packed into bit planes. Texts with the same set fall together by a 128-bit key of it: from here on one number stands for all of them.
2. Sets that share a band key are candidates. First each bucket is a star: its smallest number is paired with each other member, so the pairs are as
   many as the bucket's rows, however large the bucket. The packed bits give an estimate of the similarity (the share of equal bits,
   freed of chance matches of 2**-b); pairs far below the threshold go no further. Of each set the pair with its smallest centre is confirmed on the full
   sets first, then, between sets that aren't yet connected, the other pairs.
3. What is left are buckets whose members aren't all connected. They are compared in blocks of a bounded number of words: a task holds two blocks at a
   time, rules pairs of unconnected sets out by size and bit counts, confirms the others on the full sets, and only links leave it.
4. Components come from alternating large-star and small-star steps over the confirmed links.

So the steps are as many for any size of bucket, no bucket mates that are linked are left unconnected, and no bucket is written out as its pairs. The number of bands follows from the threshold: a link exactly at it meets in no band with a chance of ``MISS`` at most.
Comparisons of bits in step 3, and copies of texts for them (one for each block), grow with the square of the distinct members of a bucket that aren't all connected.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; fewer words than a
shingle has make one shingle. Whole texts count. Rows that repeat an id are documents of their own that carry the same number: the smallest id of what each
is linked with is its component. Null ids stay apart: their component is null, and they are kept. Other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactframe.llm.common import cut, importable, map_rows, saved

#: Minima of a band; chance to miss a link at the threshold; bits kept; standard deviations given to the estimate.
ROWS, MISS, BITS, SIGMAS = 5, 1e-7, 2, 6
#: Words whose hashes a worker keeps; members and words of a block at most (one member may have more words); sets a task keeps while it confirms pairs.
MEMO, BLOCK, WORDS, KEPT_SETS = 200_000, 256, 2**18, 32
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes. ASCII letters are lower-cased; words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > MEMO:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        out = _mix(out * _STEP[i % len(_STEP)] + h[i : i + n])
    return np.unique(_mix(out + np.uint64(min(size, len(h)))))


def set_key(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


class Signer:
    """Minima, band keys and packed low bits of shingle sets."""

    def __init__(self, k: int, seed: int = 20240229):
        self.k, self.words = k, math.ceil(k / 64)
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1)
        self.salt = rng.integers(0, 2**64, max(1, k // ROWS), dtype=np.uint64)

    def minima(self, s: np.ndarray) -> np.ndarray:
        out = np.empty(self.k, np.uint64)
        step = max(1, 32_768 // len(s))
        for i in range(0, self.k, step):
            a = self.a[i : i + step, None]
            part = a * s[None, :8192]
            best = part.min(axis=1)
            for j in range(8192, len(s), 8192):
                best = np.minimum(best, (a * s[None, j : j + 8192]).min(axis=1))
            out[i : i + step] = best
        return out

    def planes(self, m: np.ndarray) -> np.ndarray:
        """All lowest bits, then all second ones."""
        out = []
        for b in range(BITS):
            bits = np.zeros(self.words * 64, np.uint8)
            bits[: self.k] = (m >> np.uint64(b)) & np.uint64(1)
            out.append(np.packbits(bits, bitorder="little").view(np.int64))
        return np.concatenate(out)

    def sign(self, s: np.ndarray) -> tuple[list[int], list[int]]:
        """(band keys, bit planes)."""
        m = self.minima(s)
        key = self.salt.copy()
        for i in range(ROWS):
            key = _mix(key * _STEP[0] + m[i::ROWS])
        return key.view(np.int64).tolist(), self.planes(m).tolist()


def similarity(differ, k: int):
    """From the number of places whose bits differ, corrected for chance."""
    chance = 2.0**-BITS
    return ((1 - differ / float(k)) - chance) / (1 - chance)


def estimate(k: int, words: int, x: str, y: str) -> F.Column:
    """Similarity of two packed signatures by bit counts."""
    differ = None
    for i in range(words):
        bits = None
        for b in range(BITS):
            at = b * words + i
            one = F.col(x)[at].bitwiseXOR(F.col(y)[at])
            bits = one if bits is None else bits.bitwiseOR(one)
        differ = F.bit_count(bits) if differ is None else differ + F.bit_count(bits)
    return similarity(differ, k)


def deviation(j: float, k: int) -> float:
    """Standard deviation of the estimate at similarity j."""
    p = j + (1 - j) * 2.0**-BITS
    return math.sqrt(p * (1 - p) / k) / (1 - 2.0**-BITS)


def worth(threshold: float, k: int) -> float:
    """Estimates below this are given up."""
    return threshold - SIGMAS * deviation(threshold, k)


def signed_sets(docs: DataFrame, *, id_col: str, text_col: str, threshold: float, size: int) -> DataFrame:
    """(id, n_shingles, set_key, bands, planes) of each row."""

    def run(parts):
        signer = Signer(bands_for(threshold) * ROWS)
        for part in parts:
            rows = {k: [] for k in ("id", "n_shingles", "set_key", "bands", "planes")}
            for i, text in zip(part["id"], part["text"]):
                s = shingles(text, size)
                bands, planes = signer.sign(s) if len(s) else (None, None)
                for k, v in (("id", i), ("n_shingles", len(s)), ("set_key", set_key(s)), ("bands", bands), ("planes", planes)):
                    rows[k].append(v)
            yield rows

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, "id long, n_shingles long, set_key binary, bands array<long>, planes array<long>")


def texts_of(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, size: int) -> DataFrame:
    """(no, text): a text of each wanted set; ``wanted`` has (id, set_key, no)."""

    def run(parts):
        for part in parts:
            own = [(n, t) for n, t, k in zip(part["no"], part["text"], part["set_key"]) if set_key(shingles(t, size)) == k]
            yield {"no": [n for n, _ in own], "text": [t for _, t in own]}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id").select("no", "text", "set_key")
    # an id that repeats may give a set's text more than once
    return map_rows(rows, run, "no long, text string").groupBy("no").agg(F.first("text").alias("text"))


def links_of(pairs: DataFrame, texts: DataFrame, *, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets. Rows of one ``a`` stay together where they can, so that its set is made once."""

    def run(parts):
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(no: int, text: str) -> np.ndarray:
            if no in known:
                known.move_to_end(no)
                return known[no]
            known[no] = s = shingles(text, size)
            if len(known) > KEPT_SETS:
                known.popitem(last=False)
            return s

        for part in parts:
            found = []
            for a, b, x, y in zip(part["a"], part["b"], part["x"], part["y"]):
                x, y = of(a, x), of(b, y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    found.append((a, b))
            yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

    x, y = texts.select(F.col("no").alias("a"), F.col("text").alias("x")), texts.select(F.col("no").alias("b"), F.col("text").alias("y"))
    return map_rows(pairs.select("a", "b").join(y, "b").join(x, "a"), run, "a long, b long")


def block_links(members: DataFrame, *, percent: int, size: int, k: int) -> DataFrame:
    """Links (a, b) between members (key, no, n, component, planes, text) of one key and two components, without those that others make needless.

    Members of a key are dealt to classes by the binary logarithm of n and to blocks of about ``WORDS`` words. A unit is a pair of blocks of one class or of
    two neighbouring ones (sets that differ more can't be linked); a task has one unit at a time, whose pairs never leave it.
    """
    importable(members.sparkSession)
    threshold = percent / 100
    rows = members.withColumn("c", F.floor(F.log2("n")).cast("int"))
    per_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(WORDS / F.pow(F.lit(2.0), F.col("c") + 1)))).cast("int")
    blocks = rows.groupBy("key", "c").agg(F.ceil(F.count("*") / per_block).cast("int").alias("blocks"))
    blocks = blocks.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("c", "blocks"))).alias("blocks"))

    def all_of(c) -> F.Column:
        n = F.try_element_at("blocks", c)
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def unit(low, i, high, j) -> F.Column:
        return F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"))

    c, own, none = F.col("c"), F.col("own"), F.array().cast("array<struct<low:int,i:int,high:int,j:int>>")
    same = F.transform(all_of(c), lambda j: unit(c, F.least(own, j), c, F.greatest(own, j)))
    edge = F.pow(F.lit(2.0), c)
    up = F.when(F.col("n") >= 2 * threshold * edge - 1e-6, F.transform(all_of(c + 1), lambda j: unit(c, own, c + 1, j))).otherwise(none)
    down = F.when(F.col("n") * threshold < edge + 1e-6, F.transform(all_of(c - 1), lambda j: unit(c - 1, j, c, own))).otherwise(none)
    dealt = rows.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("no", "key"), F.try_element_at("blocks", c)).cast("int"))
    units = dealt.select("key", F.explode(F.concat(same, up, down)).alias("u"), "c", "own", "no", "n", "component", "planes", "text").select("key", "u.*", "c", "own", "no", "n", "component", "planes", "text")
    least, words = worth(threshold, k), math.ceil(k / 64)

    def run(table: pa.Table) -> pa.Table:
        v = {x: table.column(x).to_numpy() for x in ("low", "i", "high", "j", "c", "own", "no", "n")}
        groups = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        planes = np.array(table.column("planes").to_pylist(), np.int64).view(np.uint64).reshape(-1, BITS, words)
        sets = [shingles(t, size) for t in table.column("text").to_pylist()]
        begin = np.cumsum([0, *map(len, sets)])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(int(ids.max(initial=0)) + 1, bool)
        one = v["low"][0] == v["high"][0] and v["i"][0] == v["j"][0]
        left = np.flatnonzero((v["c"] == v["low"]) & (v["own"] == v["i"]))
        right = np.flatnonzero((v["c"] == v["high"]) & (v["own"] == v["j"]))
        out = []
        for r in left:
            s = right[v["no"][right] > v["no"][r]] if one else right
            s = s[(groups[s] != groups[r]) & (np.minimum(v["n"][s], v["n"][r]) >= threshold * np.maximum(v["n"][s], v["n"][r]) - 1e-9)]
            differ = np.bitwise_count(np.bitwise_or.reduce(planes[s] ^ planes[r], axis=1)).sum(axis=1)
            s = s[similarity(differ, k) >= least]
            if not len(s):
                continue
            mark[ids[begin[r] : begin[r + 1]]] = True
            for x in s:
                if groups[x] != groups[r]:
                    shared = int(np.count_nonzero(mark[ids[begin[x] : begin[x + 1]]]))
                    if 100 * shared >= percent * (int(v["n"][x]) + int(v["n"][r]) - shared):
                        out.append((min(v["no"][x], v["no"][r]), max(v["no"][x], v["no"][r])))
                        groups[groups == groups[x]] = groups[r]
            mark[ids[begin[r] : begin[r + 1]]] = False
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    # dealt by unit, not by key alone
    at = ("key", "low", "i", "high", "j")
    return units.repartition(*at).groupBy(*at).applyInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(no, component): the smallest number reachable over undirected links (a, b), for every number that has one."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        # large star: every neighbour above u goes to the smallest around u
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
        # small star: u and every neighbour below it go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("no"), F.col("v").alias("component"))
    return cut(stars.unionByName(stars.select(F.col("component").alias("no"), "component").distinct()))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row: linked are documents with 100 * shared >= percent * united shingles."""
    threshold = percent / 100
    k = bands_for(threshold) * ROWS
    names = {"id_col": id_col, "text_col": text_col, "size": size}
    signed = saved(signed_sets(docs, threshold=threshold, **names))
    some = signed.filter("set_key is not null and id is not null")
    # a number for each set; a written table keeps it
    sets = saved(some.groupBy("set_key").agg(F.min_by(F.struct("id", "n_shingles", "bands", "planes"), "id").alias("s")).select(F.monotonically_increasing_id().alias("no"), "set_key", "s.*"))
    rows = sets.select(F.explode("bands").alias("key"), "no")
    crowded = rows.groupBy("key").agg(F.min("no").alias("centre"), F.count("*").alias("m")).filter("m > 1")
    members = saved(rows.join(crowded, "key"))
    texts = saved(texts_of(docs, sets.join(members.select("no").distinct(), "no", "left_semi").select("id", "set_key", "no"), **names))
    signs = sets.select("no", "n_shingles", "planes")

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and bit counts don't rule out."""
        x, y = signs.toDF("a", "na", "pa"), signs.toDF("b", "nb", "pb")
        alike = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
        return pairs.join(y, "b").join(x, "a").filter(alike & (estimate(k, math.ceil(k / 64), "pa", "pb") >= worth(threshold, k))).select("a", "b")

    # of each set the smallest centre first: in a group of near copies that is mostly one
    first = members.filter("no <> centre").groupBy(F.col("no").alias("b")).agg(F.min("centre").alias("a"))
    links = saved(links_of(near(first), texts, percent=percent, size=size))
    groups = components(links)

    def grouped(df: DataFrame, no: str, name: str) -> DataFrame:
        """``df`` with the component of the set numbered ``no``, itself if it has none."""
        of = groups.select(F.col("no").alias(no), F.col("component").alias(name))
        return df.join(of, no, "left").withColumn(name, F.coalesce(name, no))

    # the other pairs of stars, between sets that aren't connected
    centres = grouped(members.filter("no = centre").select("key", "centre"), "centre", "ga").select("key", "ga")
    apart = grouped(members.filter("no <> centre"), "no", "gb").join(centres, "key").filter("ga <> gb")
    more = apart.select(F.col("centre").alias("a"), F.col("no").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    links = saved(links.unionByName(links_of(near(more), texts, percent=percent, size=size)))
    groups = components(links)
    # buckets whose members besides the centre, which has been compared with each, aren't all connected
    rest = grouped(members.filter("m > 2 and no <> centre").select("key", "no"), "no", "component")
    apart = rest.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("key")
    rest = saved(rest.join(apart, "key", "left_semi"))
    rest = rest.join(signs.withColumnRenamed("n_shingles", "n"), "no").join(texts, "no")
    links = saved(links.unionByName(block_links(rest, percent=percent, size=size, k=k)))
    groups = components(links)
    named = grouped(sets.select("no", "set_key", "id"), "no", "component")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("set_key", "component_id")
    out = signed.select("id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), "set_key").withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are: one of each group. Of rows that repeat id and set one stays; rows without an id or
    words stay all."""
    found = saved(near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent, size=size).withColumnRenamed(id_col, "id"))
    gone = found.filter("not kept").select("id").distinct()
    # where an id repeats, its rows may fare differently: these few are told apart by their sets
    twice = saved(found.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    key = F.col(id_col).cast("long")
    if twice.isEmpty():
        return docs.join(gone, key == gone["id"], "left_anti")
    once = docs.join(gone, key == gone["id"], "left_anti").join(twice, key == twice["id"], "left_anti")

    def run(batches):
        for batch in batches:
            keys = [set_key(shingles(t, size)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "__set"])

    importable(docs.sparkSession)
    at = docs.columns.index(text_col)
    from pyspark.sql.types import BinaryType, StructType

    again = docs.join(twice, key == twice["id"], "left_semi").mapInArrow(run, StructType([*docs.schema.fields]).add("__set", BinaryType()))
    stay = found.join(twice, "id", "left_semi").filter("kept").select(F.col("id").alias("__id"), F.col("set_key").alias("__key")).distinct()
    again = again.join(stay, (again[id_col].cast("long") == stay["__id"]) & again["__set"].eqNullSafe(stay["__key"]), "left_semi")
    wordless = again.filter("__set is null")
    worded = again.filter("__set is not null").dropDuplicates([id_col, "__set"])
    return once.unionByName(worded.drop("__set")).unionByName(wordless.drop("__set"))
