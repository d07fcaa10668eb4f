"""SimHash near-duplicate detection by bit-sliced comparison.

link_fingerprints: 64-bit fingerprints that differ in few bits. Blocks are exact: with radius r the bits are cut into r + 2
parts, and two fingerprints in reach agree on two whole parts at least, so every pair meets under one of the part pairs.

near_duplicates: texts whose word shingles have Jaccard similarity of at least a bound. A 64-bit fingerprint cannot tell 0.8
from 0.6, so 256 bits are compared; blocks come from MinHash bands, and an exact comparison of the shingle sets decides.

Inside a block fingerprints are stored as bit planes and compared 64 at a time (bitslice.py). Blocks above a size are cut into
pairs of bounded chunks, so no task holds an unbounded group; a block reports a spanning forest, never all of its pairs.

Edge cases: ties have no say (a bit set in exactly half the shingles is 0, classes are named by their least member); a very
long text costs time and memory in proportion to its words; null text counts as empty; texts without words share the zero fingerprint and are linked like any others; fewer
words than a shingle make one shingle; equal texts, equal rows and rows without doc_id stay rows of the result (a component
whose doc_ids are all null has a null component_id); an empty table gives an empty result; extra columns are ignored by the
detectors and returned untouched by drop_near_duplicates.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import join_labels, pairs, run_bounds, runs_of
from .common import connected_components, discard, ident, materialise, packed, small_join, tidied

SEED = 42
#: Rows of a block that are compared in one piece.
BLOCK = 1024


def shingle_hashes(text: str | None, width: int) -> list[int]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    hashed = xxhash.xxh64_intdigest
    if len(words) < width:
        return [hashed(b" ".join(words), SEED)]
    return [hashed(x, SEED) for x in map(b" ".join, zip(*(words[k:] for k in range(width))))]


def majority(hashes: np.ndarray) -> np.ndarray:
    """hashes [n, W] of uint64 -> the W words whose bits are set in over half the rows."""
    n, total = len(hashes), np.zeros(hashes.shape[1] * 64, np.int64)
    for lo in range(0, n, 8192):
        part = np.ascontiguousarray(hashes[lo : lo + 8192]).view(np.uint8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(total * 2 > n, bitorder="little").view(np.uint64)


def simhash64(text: str | None, width: int = 3) -> int:
    h = shingle_hashes(text, width)
    return int(majority(np.array(h, np.uint64)[:, None])[0]) if h else 0


def _fingerprint_batches(batches, width):
    for batch in batches:
        out = np.array([simhash64(x.as_py(), width) for x in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): 64-bit SimHash of the word shingles of every text, as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprint_batches, width=width), "doc_id long, fp long")


def _forest_batches(batches, radius, words):
    return tidied(_forests(batches, radius, words))


def _forests(batches, radius, words):
    for t in runs_of(batches, ["key", "i", "j"]):
        starts, sizes = run_bounds(t, ["key", "i", "j"])
        node = t["node"].to_numpy()
        fps = np.stack([t[f"w{k}"].to_numpy() for k in range(words)], axis=1).view(np.uint64)
        label = np.arange(len(node))
        many = sizes > 1
        for a, b in pairs(starts[many], sizes[many], fps, radius):
            join_labels(label, a, b)
        tied = label != np.arange(len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[label[tied]])], ["src", "dst"])


def in_chunks(rows: DataFrame, block: int) -> DataFrame:
    """Adds i and j: a row of a group (key) of n rows goes to the pairs of chunks that its own chunk is part of.

    A group of at most block rows is the one pair (0, 0). rows needs key, n and node.
    """
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(7), "node"), parts).cast("int")
    cut = rows.withColumn("_m", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), parts - 1)))
    return cut.withColumns({"i": F.least("_m", "_o"), "j": F.greatest("_m", "_o")}).drop("_m", "_o", "n")


def with_sizes(keyed: DataFrame) -> DataFrame:
    """Rows of the keys that several rows have, with their number n. The sizes are written first, so that a join with them
    reads both sides through exchanges and a frequent key can be split."""
    full = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    return small_join(keyed, full, ["key"], "inner")


def block_forest(keyed: DataFrame, radius: int, words: int, block: int = BLOCK) -> DataFrame:
    """keyed (key long, node long, n long, w0.. long) -> edges (src, dst) that connect all nodes of a key within radius."""
    cut = in_chunks(keyed, block)
    dealt = cut.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(partial(_forest_batches, radius=radius, words=words), "src long, dst long")


def part_keys(fp, radius: int, bits: int = 64):
    """An array of block keys of a 64-bit fingerprint: each pair of radius + 2 parts, numbered."""
    parts = radius + 2
    edge = [bits * k // parts for k in range(parts + 1)]
    piece = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edge, edge[1:])]
    return F.array(*(F.xxhash64(F.lit(k), piece[a], piece[b]) for k, (a, b) in enumerate(combinations(range(parts), 2))))


def link_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id): components of fingerprints that differ in at most radius bits."""
    single = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    keyed = single.select(F.explode(part_keys(F.col("fp"), radius)).alias("key"), F.col("fp").alias("node"), F.col("fp").alias("w0"))
    roots = connected_components(block_forest(with_sizes(keyed), radius, 1))
    named = single.join(roots, single.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that the last join reads both sides through exchanges and one frequent fingerprint can be split.
    named = materialise(named.join(least, "root").select("fp", "component_id"), "classes")
    discard(single)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    fps = materialise(fingerprints(docs, width), "fingerprints")
    linked = link_fingerprints(fps, radius)
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near duplicates by similarity

WORDS = 4
BANDS, ROWS = 25, 5
_mix = np.random.default_rng(20).integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_salt = np.random.default_rng(21).integers(1, 1 << 63, size=WORDS, dtype=np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def spread(h: np.ndarray) -> np.ndarray:
    """WORDS independent 64-bit hashes of each hash."""
    x = h[:, None] ^ _salt[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands_of(h: np.ndarray) -> np.ndarray:
    """MinHash of the shingle set, ROWS values to a band, one 64-bit key a band."""
    low = np.full(len(_mix), np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(h), 2048):
        low = np.minimum(low, (_mix[:, None] * h[None, lo : lo + 2048]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = (key ^ low[r::ROWS]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key


def _sketch_batches(batches, width):
    return tidied(_sketches(batches, width))


def _sketches(batches, width):
    for batch in batches:
        ids, text, keys, fps = [], [], [], []
        for k, x in enumerate(batch.column(1)):
            h = shingle_set(x.as_py(), width)
            ids.append(k)
            keys.append(bands_of(h))
            fps.append(majority(spread(h)) if len(h) else np.zeros(WORDS, np.uint64))
        if not ids:
            continue
        fp = np.array(fps).view(np.int64)
        flat = pa.array(np.concatenate(keys).view(np.int64))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), flat)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), bands, *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(WORDS))],
            ["digest", "bands", *(f"w{k}" for k in range(WORDS))],
        )


def bits_apart(shared: int, one: int, other: int) -> float:
    """Chance that a majority bit of two sets differs, exactly: so many hashes in both sets, in the first and in the second alone."""
    def over(own: int, held: int) -> float:  # the first held shared hashes have the bit set: is it set in over half?
        need = (shared + own) // 2 + 1 - held
        return sum(comb(own, k) for k in range(max(0, need), own + 1)) / 2**own

    both = ((comb(shared, k) / 2**shared, over(one, k), over(other, k)) for k in range(shared + 1))
    return sum(w * (a * (1 - b) + (1 - a) * b) for w, a, b in both)


@lru_cache
def radius_for(similarity: float, sds: float = 4.5) -> int:
    """Hamming radius that a pair of that Jaccard similarity exceeds only sds standard deviations out.

    Small sets differ more than the angle of large ones says, as ties are zeros: for them the chance is counted out.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    for shared in range(1, 41):
        apart = int(shared * (1 - similarity) / similarity + 1e-9)
        p = max(p, *(bits_apart(shared, x, y) for x in range(apart + 1) for y in range(apart + 1 - x)))
    n = 64 * WORDS
    return int(n * p + sds * np.sqrt(n * p * (1 - p)))


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verified_batches(batches, radius, similarity, width):
    return tidied(_verified(batches, radius, similarity, width))


def _verified(batches, radius, similarity, width):
    for t in runs_of(batches, ["key", "i", "j"], rows=2000, size=8 << 20):
        starts, sizes = run_bounds(t, ["key", "i", "j"])
        node = t["node"].to_numpy()
        texts = t["text"]
        sets = [shingle_set(x.as_py(), width) for x in texts]
        length = np.array([len(s) for s in sets])
        fps = np.stack([t[f"w{k}"].to_numpy() for k in range(WORDS)], axis=1).view(np.uint64)
        up = list(range(len(node)))

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        many = sizes > 1
        for reach in (radius // 3, radius):  # close pairs first: they join classes and spare later checks
            for a, b in pairs(starts[many], sizes[many], fps, reach):
                fits = np.minimum(length[a], length[b]) >= similarity * np.maximum(length[a], length[b])
                for x, y in zip(a[fits].tolist(), b[fits].tolist()):
                    p, q = find(x), find(y)
                    if p != q and _jaccard(sets[x], sets[y]) >= similarity:
                        up[max(p, q)] = min(p, q)
        root = np.array([find(x) for x in range(len(node))])
        tied = root != np.arange(len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[root[tied]])], ["src", "dst"])


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, digest, copies, class_id): one row per distinct (doc_id, text), copies the number of such rows.

    class_id numbers the components of texts with similarity at or above the bound. Texts are told apart by their MD5: equal
    ones meet by it first, so copies never multiply work; of each text one instance is compared.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    kinds = "digest binary, bands array<long>, " + ", ".join(f"w{k} long" for k in range(WORDS))
    sketch = rows.select("digest", "text").mapInArrow(partial(_sketch_batches, width=width), kinds)
    # Numbered once and written, so that the numbers stay what they are.
    sketch = materialise(sketch.dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id()), "sketch")
    w = [f"w{k}" for k in range(WORDS)]
    radius = radius_for(similarity)
    # Keys move without the fingerprints; those follow to the texts that share a key.
    keys = sketch.select(F.explode("bands").alias("key"), "node")
    shared = materialise(with_sizes(keys), "keys")
    owners = materialise(small_join(sketch.select("node", *w), shared.select("node").distinct(), ["node"], "left_semi"), "owners")
    coarse = connected_components(block_forest(shared.join(owners, "node"), radius, WORDS, block))
    grouped = coarse.select("node", F.col("root").alias("key")).union(coarse.select("root", "root").distinct())
    grouped = materialise(grouped, "groups")
    members = with_sizes(grouped).join(owners, "node").join(sketch.select("node", "digest"), "node")
    members = materialise(members, "members")
    # Only texts that may have a near copy move; of equal texts one.
    texts = small_join(rows.select("digest", "text"), members.select("digest"), ["digest"], "left_semi").dropDuplicates(["digest"])
    members = texts.join(members, "digest").select("key", "n", "node", "text", *w)
    dealt = in_chunks(members, block).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = dealt.mapInArrow(partial(_verified_batches, radius=radius, similarity=similarity, width=width), "src long, dst long")
    roots = connected_components(links)
    held = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    named = sketch.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("class_id"))
    out = materialise(held.join(named, "digest").select("doc_id", "digest", "copies", "class_id"), "classes")
    for used in (sketch, shared, owners, grouped):
        discard(used)
    return out


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one document (the least doc_id, then the least digest) of each near-duplicate class."""
    found = near_duplicates(docs, width, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("digest").alias("t"))
    first = found.groupBy("class_id").agg(F.min_by(F.struct("doc_id", "digest"), order).alias("k")).select("class_id", "k.*")
    first = materialise(first, "kept")
    same = found.join(first.withColumnsRenamed({"doc_id": "d", "digest": "t", "class_id": "c"}), F.col("class_id") == F.col("c"))
    kept = found.doc_id.eqNullSafe(F.col("d")) & (found.digest == F.col("t"))
    # What is dropped, and what is repeated row for row; every other row stays where it is.
    marks = same.select(ident(F.col("doc_id")).alias("id"), "digest", kept.alias("kept"), "copies").where("not kept or copies > 1")
    marks = materialise(marks.drop("copies"), "marks")
    marked = small_join(packed(docs), marks, ["id", "digest"], "left")
    again = marked.where("kept").dropDuplicates(["id", "digest"])
    return marked.where("kept is null").select("row.*").unionByName(again.select("row.*"))
