"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, by wide SimHash and Golay keys, and then exactly.

Similar texts differ in more bits of a SimHash than pigeonhole keys can bear: at a similarity of 0.8 each bit differs with
a probability of 0.15. The fingerprint is therefore wide (256 bits), nine of its segments of 23 bits are decoded to the
indices of nearby Golay codewords (one or six, see golay), and each of these keys is joined to one least hash of the
shingles, which stands for the exact block that the short fingerprint has. Texts that share a key meet in a bucket, where
each is tied to the first one within 54 bits, before the shuffle already; these ties are verified on whole texts.

These links find most groups but are a start only. An exact pass (see closed) then compares what they have not joined. Two sets
of this similarity differ in at most a quarter of the smaller one's shingles; dealt by hash into more parts than that, some
part is the same in both (see part_keys), and seldom by chance, however many texts there are. Texts with too many parts that
are empty, or hold frequent shingles only, also meet by single shingles: in any fixed order of all shingles, two sets of this
similarity share one among their first n - ceil(0.8 n) + 1 ones. Texts that meet are compared until no untested pair crosses
two components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, golay
from .graph import components, labels, shortened

SEED, PARTS, TABLES = 42, 4, 9
#: Bits that may differ between a member of a bucket and the one it is tied to. Pairs beyond are left to the exact pass.
MAX_BITS = 54
#: Rows that are tied at once; this bounds memory and changes no result.
ROWS = 100_000
#: Round r of the exact pass takes up the first BASE**r members of a bucket, or about as many.
BASE, LEVELS = 8, 7
#: Once the pairs left in buckets, whatever they are, number no more than this for each text, one round takes them all.
FEW = 8
WIDE, LEAST = [f"s{i}" for i in range(PARTS)], [f"m{i}" for i in range(TABLES)]
#: Two sums that stand for the whole set of shingles: texts with equal ones are one node.
WHOLE = ["w0", "w1"]
#: Ids that are sent to all executors rather than all texts through a shuffle (a bound on what is broadcast, about 32 MB).
SENT_IDS = 2_000_000
#: Keys of parts that a task holds at once, about, and bytes of a key as it is sent.
KEYS, KEY_BYTES = 1_000_000, 6
#: Texts that frequent shingles are looked for in, and how many are kept. Both only set the order of shingles, never what is found.
ORDER_TEXTS, ORDER_SHINGLES = 20_000, 100_000

#: Fixed values of the splitmix64 generator.
STEP, MUL_1, MUL_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray, number: int) -> np.ndarray:
    """Hashes of another hash function, by its number."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(number) * STEP
        x = (x ^ (x >> np.uint64(30))) * MUL_1
        x = (x ^ (x >> np.uint64(27))) * MUL_2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, k: int) -> set[bytes]:
    """The set of k-word shingles; the whole sequence where there are fewer words."""
    words = (text or b"").lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def hashes(text: bytes | None, k: int) -> np.ndarray:
    """The hashes of a text's shingles, in no order."""
    from xxhash import xxh64_intdigest

    found = shingles(text, k)
    return np.fromiter((xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))


def sketches(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(wide fingerprints, least hashes) of texts' shingle hashes; zeros for a text without words."""
    wide, least = np.zeros((len(found), PARTS), np.uint64), np.zeros((len(found), TABLES), np.uint64)
    for n, h in enumerate(found):
        if not len(h):
            continue
        counts = np.zeros(64 * PARTS, np.int64)
        for at in range(0, len(h), 4096):
            rows = np.stack([mixed(h[at : at + 4096], i) for i in range(PARTS)], axis=1)
            counts += np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        wide[n] = np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)
        least[n] = [mixed(h, PARTS + i).min() for i in range(TABLES)]
    return wide, least


def prefix(h: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first hashes of a set by (how often they are in the sorted frequent ones, value): similar sets share one of these."""
    if not len(h):
        return h
    often = np.zeros(len(h), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        often = np.where(frequent[at] == h, counts[at], 0)
    return h[np.lexsort((h, often))][: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]


def whole_sum(h: np.ndarray, i: int) -> np.uint64:
    """A sum that stands for the whole set of hashes."""
    return mixed(h, PARTS + TABLES + i).sum(dtype=np.uint64)


def size_classes(similarity: float, most: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least sizes, parts, spare parts) of the classes of set sizes. A similar set is in the same class or in one next to it.

    The smaller of two similar sets has n shingles of class c, and they differ in at most (1 - s) / s * n. So of c's parts at
    least one more than the spare ones are the same in both. There are as many spare ones as are usually empty, and some more.
    """
    start = [1]
    while start[-1] < most:
        start.append(int(start[-1] * 1.25) + 1)
    start = np.array(start, np.int64)
    differ = np.floor((1 - similarity) / similarity * (start[1:] - 1) + 1e-6).astype(np.int64)
    start, spare = start[:-1], np.zeros(len(differ), np.int64)
    for _ in range(50):
        parts = differ + 1 + spare
        empty = parts * np.exp(-start / parts)
        spare = np.maximum(spare, np.ceil(empty + 2.5 * np.sqrt(empty)).astype(np.int64) * (differ > 0))
    return start, differ + 1 + spare, spare


def part_keys(found: list[np.ndarray], similarity: float, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sets, keys, whether each set is sparse). Two similar sets have a key in common, unless both are sparse.

    A set is dealt twice: for pairs whose smaller one is of its class, and for those whose smaller one is of the class below.
    Each part with a shingle that is not frequent makes a key. A set is sparse if more than the spare parts make none.
    """
    start, parts, spare = size_classes(similarity)
    n = np.array([len(h) for h in found], np.int64)
    sparse, owners, keys = np.zeros(len(found), bool), [], []
    every = np.concatenate([*found, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(found)), n)
    rare = np.ones(len(every), bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, every), len(frequent) - 1)] != every
    place, value = mixed(every, 101), mixed(every, 102)
    for below in range(2):
        cls = np.searchsorted(start, n, "right") - 1 - below
        there = cls >= 0
        m = np.where(there, parts[cls], 0)
        first = np.cumsum(m) - m
        held = np.flatnonzero(there[owner])
        slot = first[owner[held]] + (place[held] % m[owner[held]].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(int(m.sum()), np.uint64)
        np.add.at(sums, slot, value[held])
        full = np.bincount(slot[rare[held]], minlength=len(sums)) > 0
        of = np.repeat(np.arange(len(found)), m)
        number = (np.arange(len(sums)) - first[of]).astype(np.uint64) | cls[of].astype(np.uint64) << np.uint64(40)
        sparse |= there & (np.bincount(of[~full], minlength=len(found)) > spare[cls])
        owners.append(of[full])
        keys.append(mixed(sums[full] ^ mixed(number[full], 103), 104))
    return np.concatenate(owners), np.concatenate(keys), sparse


def part_rows(k: int, similarity: float, frequent: np.ndarray, buckets: int):
    """Texts to rows (bucket, rows): the keys of parts in this bucket, KEY_BYTES each, then the sets that have them, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, met = [], 0, set()

        def out() -> pa.RecordBatch:
            key, whole = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, whole, bucket = key[order], whole[order], bucket[order]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            cut = [slice(a, b) for a, b in zip(first, np.append(first[1:], len(bucket)), strict=True)]
            rows = [np.ascontiguousarray(key[c].view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes() + whole[c].tobytes() for c in cut]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "rows"])

        for batch in batches:
            found = {}
            for h in (hashes(t, k) for t in common.whole_text(batch.column("text"))):
                if (w := whole_sum(h, 0)) not in met:  # a copy has the same keys
                    met.add(w)
                    found[w] = h
            owner, key, _ = part_keys(list(found.values()), similarity, frequent)
            held.append((key & np.uint64((1 << 8 * KEY_BYTES) - 1), np.array(list(found), np.uint64)[owner]))
            count += len(key)
            if count > KEYS:
                yield out()
                held, count = [], 0
        if count:
            yield out()

    return run


def part_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of part_rows(), whole buckets, to (key, w0, size) of the keys that several sets have."""
    keys, wholes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        for rows in batch.column("rows").to_pylist():
            n = len(rows) // (KEY_BYTES + 8)
            key = np.zeros((n, 8), np.uint8)
            key[:, :KEY_BYTES] = np.frombuffer(rows, np.uint8, n * KEY_BYTES).reshape(n, KEY_BYTES)
            keys.append(key.reshape(-1).view(np.uint64))
            wholes.append(np.frombuffer(rows, np.uint8, offset=n * KEY_BYTES).copy().view(np.uint64))
    key, whole = np.concatenate(keys), np.concatenate(wholes)
    order = np.lexsort((whole, key))
    key, whole = key[order], whole[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
    key, whole = key[new], whole[new]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(key))
    size = np.repeat(size, size)
    key, whole, size = key[size > 1], whole[size > 1], size[size > 1]
    for a in range(0, len(key), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + ROWS].view(np.int64)) for x in (key, whole, size)], names=["key", "w0", "size"])


def sketch(k: int, similarity: float, frequent: np.ndarray, counts: np.ndarray):
    """A UDF: text -> struct of the fingerprint's parts, the least hashes and the sums of the set, as signed numbers, the set's size and, of a sparse set, its prefix."""

    def start():
        def run(texts: list[bytes | None]):
            found = [hashes(t, k) for t in texts]
            wide, least = sketches(found)
            whole = np.array([[whole_sum(h, i) for i in range(2)] for h in found], np.uint64).reshape(-1, 2)
            sparse = part_keys(found, similarity, frequent)[2]
            first = pa.array([prefix(h, similarity, frequent, counts).view(np.int64) if s else [] for h, s in zip(found, sparse, strict=True)], pa.list_(pa.int64()))
            return (*(np.ascontiguousarray(c).view(np.int64) for c in (*wide.T, *least.T, *whole.T)), np.array([len(h) for h in found], np.int32), first)

        return run

    return common.text_udf(start, ", ".join(f"{c} bigint" for c in WIDE + LEAST + WHOLE) + ", n int, first array<bigint>")


def frequent_shingles(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that several of some texts hold. They come last in the order of shingles; the order changes the cost only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes(t, k) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["h"])

    some = common.share_of(texts, ORDER_TEXTS / max(1, texts.count()), SEED, "id").select("text").mapInArrow(run, "h bigint")
    rows = some.groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(ORDER_SHINGLES).toPandas()
    h, counts = rows["h"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], counts[order]


def bucket_keys(wide: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint's place, key) of every key: 9 to 54 a fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(wide), -1), axis=1, bitorder="little")
    places, out = [], []
    for t in range(TABLES):
        near = golay.keys(bits[:, t * golay.BITS : (t + 1) * golay.BITS].astype(np.int64) @ (1 << np.arange(golay.BITS)))
        row, col = np.nonzero(near >= 0)
        places.append(row)
        out.append(mixed(least[row, t] ^ (near[row, col].astype(np.uint64) * MUL_2), t))
    return np.concatenate(places), np.concatenate(out)


def columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Columns of 64-bit numbers as one unsigned matrix."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names], axis=1)


def ties(key: np.ndarray, n: np.ndarray, wide: np.ndarray, similarity: float) -> np.ndarray:
    """Of rows sorted by key: the place of the first row of its bucket that each is close to, its own where there is none.

    Every pass compares all rows left with the first one left of their buckets.
    """
    lead, left = np.arange(len(key)), np.arange(len(key))
    while len(left):
        first = np.flatnonzero(np.append(True, key[left][1:] != key[left][:-1]))
        head = left[np.repeat(first, np.diff(first, append=len(left)))]
        near = np.bitwise_count(wide[left] ^ wide[head]).sum(1) <= MAX_BITS
        near &= np.minimum(n[left], n[head]) >= similarity * np.maximum(n[left], n[head]) - 1e-9
        lead[left[near]] = head[near]
        left = left[~near]
    return lead


def tied(key: np.ndarray, ids: np.ndarray, n: np.ndarray, wide: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of those that are tied to none, ids of the tied ones, ids they are tied to)."""
    lead = ties(key, n, wide, similarity)
    free = lead == np.arange(len(key))
    return np.flatnonzero(free), ids[~free], ids[lead[~free]]


def keyed(similarity: float):
    """Sketches to rows (key, id, to, n, fingerprint): members of buckets, and ties (id, to) found already among the rows at hand.

    So a bucket that holds many of all rows sends few of them through the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.gathered(batches, ROWS // (TABLES * 2)):
            wide = columns(batch, WIDE)
            row, key = bucket_keys(wide, columns(batch, LEAST))
            order = np.argsort(key, kind="stable")
            row, key = row[order], key[order].view(np.int64)
            ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()[row]
            free, u, v = tied(key, ids[row], n, wide[row], similarity)
            parts = [pa.array(wide[row[free], i].view(np.int64)) for i in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(key[free]), pa.array(ids[row[free]]), pa.nulls(len(free), pa.int64()), pa.array(n[free]), *parts], names=["key", "id", "to", "n", *WIDE])
            u, v = np.unique(np.stack([u, v], axis=1).reshape(-1, 2), axis=0).T
            none = [pa.nulls(len(u), pa.int64())] * PARTS
            yield pa.RecordBatch.from_arrays([pa.array(mixed(u.view(np.uint64), 0).view(np.int64)), pa.array(u), pa.array(v), pa.nulls(len(u), pa.int32()), *none], names=["key", "id", "to", "n", *WIDE])

    return run


def close(similarity: float):
    """Edges of rows of keyed() that are sorted by key. Of the bucket that may go on, it keeps those tied to none."""

    def edges(u, v) -> pa.RecordBatch:
        pairs = np.stack([u, v], axis=1).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, n, wide = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, PARTS), np.uint64)
        for batch in common.gathered(batches, ROWS):
            done = batch.column("to").is_valid()
            known, batch = batch.filter(done), batch.filter(pc.invert(done))
            yield edges(known.column("id").to_numpy(), known.column("to").to_numpy())
            key, ids, n = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((key, "key"), (ids, "id"), (n, "n")))
            wide = np.concatenate([wide, columns(batch, WIDE)])
            free, u, v = tied(key, ids, n, wide, similarity)
            yield edges(u, v)
            last = free[key[free] == key[-1]] if len(key) else free
            key, ids, n, wide = key[last], ids[last], n[last], wide[last]

    return run


def verified(k: int, similarity: float):
    """Rows (u, v, a, b) whose texts a and b are similar, as edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("a", "b"))
            keep = []
            for x, y in zip(a, b, strict=True):
                s, t = shingles(x, k), shingles(y, k)
                both = len(s & t)
                keep.append(both >= similarity * (len(s) + len(t) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def links_of(edges: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The edges (u, v) whose whole texts (id, text) are similar. Ids are unique, and sizes of edges' ends alike, so a text joined to its edges is no larger than what it is compared with."""
    ends = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).distinct()
    ids = common.stored(ends, "ends")
    ends = common.stored(texts.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "id", "left_semi"), "texts")
    common.release(ids)
    pairs = edges.join(ends.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(ends.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
    links = common.stored(pairs.select("u", "v", "a", "b").mapInArrow(verified(k, similarity), "u bigint, v bigint"), "links")
    common.release(ends)
    return links


def meetings(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (key, id, n, pos, score, level) of the parts (key, w0, size) and the shingles of prefixes that several texts have; pos: the place in the prefix, 0 for a part.

    Texts are ordered by score: those whose keys others share most come first, as the origin of a group of copies does. The
    level is the round in which a text is compared with all after it in its bucket: about the first BASE**r of them in round
    r. Levels come from quantiles, which are aggregated before the shuffle, so a bucket with many of all texts needs no sort.
    """
    held = classes.filter("n > 0").select("id", "n", F.posexplode("first").alias("pos", "key"))
    sizes = common.stored(held.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    by_part = parts.join(classes.select("w0", "id", "n"), "w0").select("key", "id", "n", F.lit(0).alias("pos"), "size")
    met = common.stored(by_part.union(held.join(sizes, "key").select(by_part.columns)), "keys")
    common.release(sizes)
    noise = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 40))
    scores = met.groupBy("id", "n").agg(F.count(F.lit(1)).alias("shared")).select("id", (F.col("shared") / F.col("n") + noise).alias("score"))
    keys, met = met, common.stored(met.join(scores, "id"), "met")
    common.release(keys)
    bounds = met.groupBy("key").agg(F.percentile_approx("score", F.array(*(F.lit(1 - float(BASE) ** -j) for j in range(1, LEVELS + 1)))).alias("bounds"))
    met_to = met.join(bounds, "key")
    above = sum((F.col("score") >= F.col("bounds")[j]).cast("int") for j in range(LEVELS))
    full = F.ceil(F.log(F.col("size").cast("double")) / math.log(BASE) - 1e-9).cast("int")
    ranked = common.stored(met_to.withColumn("level", F.greatest(full - above, F.lit(0))).drop("bounds", "size"), "ranked")
    common.release(met)
    return ranked


def closed(classes: DataFrame, parts: DataFrame, texts: DataFrame, tested: DataFrame, links: DataFrame, k: int, similarity: float) -> DataFrame:
    """Edges that connect what the given links connect, and all other similar texts.

    Texts that share a part, or a shingle of their prefixes, meet in a bucket. Round r compares the texts of level r with all after them
    that are not known to be connected with them, so each pair is compared in the round of its first text or is joined by
    then. The last round takes all that are left, once they are few. Pairs whose sizes or whose places of the shingle rule
    the similarity out are not compared: of a pair's first common shingle both bounds hold.
    """
    met, level, edges = meetings(classes, parts), 0, shortened(links)
    common.collect_garbage(texts.sparkSession)
    few = FEW * classes.count()
    while True:
        known = labels(edges)
        now = met.drop("component", "members").join(known.select(F.col("node").alias("id"), F.col("label").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_keys = now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("members")).filter("a < b").select("key", "members")
        still = common.stored(now.join(open_keys, "key"), "open")
        common.release(met)
        met = still
        most, pairs_left = met.agg(F.max("level"), F.sum("members")).first()
        if most is None or most < level:
            common.release(met)
            return edges
        x, y = (met.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "pos", "score", "level", "component"))) for side in "xy")
        last = pairs_left <= few
        pairs = x.filter(F.col("level_x") >= level if last else F.col("level_x") == level).join(y, "key").filter("component_x <> component_y")
        pairs = pairs.filter("score_x > score_y or score_x = score_y and id_x > id_y")
        both = F.least(F.expr("n_x - pos_x"), F.expr("n_y - pos_y"))  # the shared one and all after it
        pairs = pairs.filter(F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * similarity - 1e-9)
        pairs = pairs.filter(both >= (F.col("n_x") + F.col("n_y")) * (similarity / (1 + similarity)) - 1e-9)
        pairs = pairs.select(F.least("id_x", "id_y").alias("u"), F.greatest("id_x", "id_y").alias("v")).distinct()
        pairs = common.stored(pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        found, before = links_of(pairs, texts, k, similarity), edges
        tested, edges = tested.union(pairs), shortened(edges.union(found))
        common.release(found, before)
        if last:
            common.release(met)
            return edges
        level += 1


def row_components(texts: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component) of every row of texts (id, text), whose ids are unique, not null, and the same each time. Component: its least id."""
    if not 0.8 <= similarity <= 1:
        raise ValueError("the keys find similarities of 0.8 or more")
    common.prepare(texts.sparkSession)
    frequent = frequent_shingles(texts, shingle)
    all_rows = common.stored(texts.select("id", sketch(shingle, similarity, *frequent)("text").alias("f")).select("id", "f.*"), "sketches")
    rows = common.stored(all_rows.select("id", *WHOLE, "n"), "sets")
    classes = all_rows.groupBy(*WHOLE, "n").agg(F.min("id").alias("id"), *(F.min(c).alias(c) for c in WIDE + LEAST), F.first("first").alias("first"))
    classes = common.stored(classes, "classes")
    common.release(all_rows)
    common.collect_garbage(texts.sparkSession)
    buckets = math.ceil((classes.agg(F.sum("n")).first()[0] or 0) * 0.6 / KEYS) + 1
    parts = texts.select("text").mapInArrow(part_rows(shingle, similarity, frequent[0], buckets), "bucket int, rows binary")
    parts = common.stored(parts.repartition(buckets, "bucket").mapInArrow(part_meetings, "key bigint, w0 bigint, size bigint"), "parts")
    common.collect_garbage(texts.sparkSession)
    sent = f"key bigint, id bigint, to bigint, n int, {', '.join(f'{c} bigint' for c in WIDE)}"
    buckets = classes.select("id", "n", *WIDE, *LEAST).filter("n > 0").mapInArrow(keyed(similarity), sent)
    edges = buckets.repartition("key").sortWithinPartitions("key", "id").mapInArrow(close(similarity), "u bigint, v bigint")
    edges = common.stored(edges.filter("u <> v").distinct(), "candidates")
    links = links_of(edges, texts, shingle, similarity)
    common.collect_garbage(texts.sparkSession)
    groups = components(closed(classes, parts, texts, edges, links, shingle, similarity)).withColumnRenamed("node", "id")
    known = common.stored(classes.select("id", *WHOLE, "n").join(groups, "id", "left").select(*WHOLE, "n", F.coalesce("component", "id").alias("component")), "members")
    common.release(classes, parts)
    return rows.join(known, [*WHOLE, "n"]).select("id", "component")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: its id, component_id (least id of the texts that links of this similarity reach).

    Texts without words (null ones too) are one component. A null id joins its component but is never its least id; a component
    of null ids only has a null component_id. Equal rows, and different texts with one id, are rows of their own. An empty
    table gives none; other columns are not read, whatever their names. Texts with equal sets of shingles are one node.
    Every link is verified on whole texts, and every two texts of this similarity are in one component (shingles count as
    equal where their 64-bit hashes are). The keys are made for similarities of 0.8 or more; less is refused.
    """
    rows = common.numbered(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "id")
    members = common.stored(rows.select("id", "doc").join(row_components(rows.select("id", "text"), shingle, similarity), "id"), "of_rows")
    least = members.groupBy("component").agg(F.min("doc").alias("component_id"))
    return members.join(least, "component").select(F.col("doc").alias(id_col), "component_id")
