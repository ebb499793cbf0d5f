"""SimHash near-duplicates by anchor-point covering.

Anchors.  A fingerprint has 64 bits in two halves a and b; two that link differ in at most 2.  So
they differ in at most 1 bit of each half, or in at most 2 of one half and in none of the other.
Three covering codes take these cases, each the product of a code on one half and of all words of
a block of the other (of which one block at least is equal):

* at most 1 bit in each half: the perfect Hamming code on bits 1..31 of a (covering radius 1, threshold
  1) times all words of a 16-bit block of b (radius 0, threshold 0), for both blocks;
* none in a: all words of a times all words of a third of b, for the three thirds;
* none in b: the same with the halves exchanged.

Every distinct fingerprint is sent to its home anchors and to all anchors within radius + threshold
of each code (16 * 2 + 3 + 3 copies), and each anchor compares its homes with its guests.  The second
half's part of an anchor is what keeps one that many fingerprints crowd around small: its members
agree in 16 bits of b besides.  It is the same for all anchors.  (Taking all 63 bits at once would
need 652 copies.)

Groups are the connected components, by alternating large-star and small-star steps over all tasks,
or by one task if there are at most ``TOGETHER`` links.

Defined results: a null or blank text has fingerprint zero and links like any other; fewer words
than a shingle make one shingle; equal texts have equal fingerprints; repeated rows are kept;
an empty table gives no rows; extra columns are ignored; a null doc_id never names a group unless
all ids of the group are null.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, slices

SHINGLE = 3
SEED = 42
THRESHOLD = 2
#: Edges that one task joins in memory (some 100 MB).  Every exchange of a round costs the driver a thread
#: and its plans, at any size, so rounds are kept for more edges.
TOGETHER = 1_000_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    rows = h.view(np.uint8).reshape(-1, 8)
    if len(rows) < 2000:
        return np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BITS for k in range(8)])


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    counts, total, carry = np.zeros(64, np.int64), 0, []
    for part in slices(text or "", ascii_spaces=True):
        w = carry + part.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII spaces only
        n = len(w) - words + 1
        if n > 0:
            joined = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
            counts += _counts(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64, n))
            total += n
        carry = w[-(words - 1) :] if words > 1 else []
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(carry), seed) if carry else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def anchors() -> tuple[F.Column, F.Column]:
    """(_s, array<struct<key, home>>): the anchors of the Hamming code on bits 1..31 within 2 of the
    fingerprint, the home one marked; the second needs the first as a column.

    The syndrome s (the exclusive or of the places of set bits) is 0 on code words.  Otherwise the
    home anchor is bit s flipped, and those at distance 2 flip places i and i^s for each i.
    """
    word = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFE))
    masks = [sum(1 << i for i in range(1, 32) if i >> b & 1) for b in range(5)]
    s = F.lit(0)
    for b, mask in enumerate(masks):
        s = s + F.bit_count(word.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * F.lit(1 << b)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    entry = lambda key, home: F.struct(key.alias("key"), F.lit(home).alias("home"))
    # Guests by pairs i < i^s; i runs over 1..31 without s.  Of each pair the smaller place stands.
    pairs = F.expr("filter(sequence(1, 31), i -> i < (i ^ _s) and i != _s)")
    guests = F.transform(pairs, lambda i: entry(word.bitwiseXOR(bit(i).bitwiseXOR(bit(i.bitwiseXOR(F.col("_s"))))), False))
    home = F.array(entry(word.bitwiseXOR(F.when(F.col("_s") == 0, F.lit(0).cast("long")).otherwise(bit(F.col("_s")))), True))
    return s.cast("int"), F.when(F.col("_s") == 0, home).otherwise(F.concat(home, guests))


def at_anchors(fps: DataFrame) -> DataFrame:
    """code, key, block, fp, home: every distinct fingerprint at the anchors of the three codes."""
    s, found = anchors()
    half = lambda k: F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))
    part = lambda low, bits, k: F.struct(F.lit(k).alias("code"), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("block"))
    near = fps.withColumn("_s", s).select("fp", F.explode(found).alias("a"))
    near = near.select("fp", "a.*", F.explode(F.array(part(32, 16, 0), part(48, 16, 1))).alias("p"))
    out = near.select("p.code", "key", "p.block", "fp", "home")
    for k in (0, 1):
        low = 32 * (1 - k)
        thirds = F.array(part(low, 11, 2 + 3 * k), part(low + 11, 11, 3 + 3 * k), part(low + 22, 10, 4 + 3 * k))
        same = fps.select("fp", half(k).alias("key"), F.explode(thirds).alias("p"))
        out = out.unionByName(same.select("p.code", "key", "p.block", "fp", F.lit(True).alias("home")))
    return out


def links(fps: DataFrame) -> DataFrame:
    """u, v (u > v): all links between distinct fingerprints."""
    at = at_anchors(fps)
    where = ["code", "key", "block"]
    near = at.filter("home").select(*where, F.col("fp").alias("u")).join(at.select(*where, F.col("fp").alias("v")), where)
    near = near.filter((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= THRESHOLD))
    return near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges u, v, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``components`` of at most TOGETHER edges."""

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        node, root = smallest_reachable(*(np.concatenate(x) for x in zip(*got, strict=True))) if got else (np.zeros(0, np.int64),) * 2
        for k in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (node, root)], names=["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for nodes that have an edge (u > v).

    Alternating large-star and small-star steps until nothing changes; each halves path lengths or
    so, every round's edges are checkpointed, and the end is told by a sum over the edges.  At most
    TOGETHER edges are joined by one task.
    """
    edges = checkpoint(edges)
    last = None
    while True:
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last or not sign[0]:
            break
        if sign[0] <= TOGETHER:
            return _in_one_task(edges)
        last = sign
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = checkpoint(small.filter("u != v").distinct())
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links, itself included)."""
    marked = checkpoint(fingerprints(docs))
    nodes = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpoint(components(links(nodes.select("fp"))))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(names, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without the later ones of each near-duplicate group: the smallest doc_id
    stays (of repeated rows with that id, one)."""
    return first_of(docs, near_groups(docs))


def first_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents without the later ones of the groups given (doc_id, component_id)."""
    marked = checkpoint(groups)
    (key,) = fresh(docs, "_later")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    later = marked.filter(~first).select(F.col("doc_id").alias(key))
    repeated = checkpoint(marked.filter(first).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(key)))
    same = F.col("doc_id").eqNullSafe(F.col(key))
    kept = docs.join(later, same, "left_anti")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id"]))


def hex64(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
