"""Near-duplicates by the Jaccard similarity of word shingles, exact, by prefix filtering.

Two documents link if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
With all shingles in one common order, two sets that link have one in common among the first
n - ceil(0.8 * n) + 1 of each (n: the size of the set).  So only these prefixes are joined, and
each pair that meets is checked on the whole sets, unless counts already rule it out: a set's shingles
are counted by residue, over about half as many residues as shingles, and what one set has more than
the other at a residue isn't common.  Any order gives the right result; shingles
that are frequent in a bounded sample come last, so that common lines seldom stand in a prefix.

Hot shingles.  A shingle in more than ``hot`` prefixes would compare the square of them.  Its
members are compared in blocks of about ``BLOCK``, twice with other blocks; after that only pairs
of members in different components matter, and those are all compared but for the pairs inside the
shingle's largest component.  Members carry a bitmap of their set, which rules most pairs out before
they are made.  Nothing is left out; comparisons grow with the members outside that component.

Joins with tables of a row a set are named merge joins: their sides grow with the input, and those that
are small enough to be sent would each go through the driver, some forty a run.

Groups are the connected components.  Defined results: as for ``simhash``; texts without a word
are alike, fewer words than a shingle make one shingle, A-Z and ASCII spaces don't count.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import checkpoint, slices
from .simhash import SEED, components, first_of

WORDS = 5
SIMILARITY = 0.8
HOT = 64
BLOCK = 16
WORDS_OF_BITS = 16  # longs of a hot member's bitmap
SAMPLE = 20_000  # documents whose shingles are counted for the order
OFTEN = 8  # times in the sample: a frequent shingle
MOST_FREQUENT = 200_000
MOST = 127  # shingles of a residue


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The text's distinct shingles as sorted hashes; never empty."""
    parts, carry = [], []
    for part in slices(text or "", ascii_spaces=True):
        w = carry + part.encode("utf-8", "surrogatepass").lower().split()
        n = len(w) - words + 1
        if n > 0:
            joined = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
            parts.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)))
            carry = w[n:]
        else:
            carry = w
    if not parts:
        parts = [np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def _least(n: int, similarity: float) -> int:
    """The least overlap of a set of n with one that links to it."""
    return max(1, math.ceil(similarity * n - 1e-9))


def _counts(h: np.ndarray) -> np.ndarray:
    """How many shingles have each residue, at most MOST told; a power of two of residues."""
    residues = 1 << max(0, (len(h) // 2).bit_length() - 1)
    return np.minimum(np.bincount((h & np.uint64(residues - 1)).astype(np.int64), minlength=residues), MOST).astype(np.int8)


def _folded(a: str, b: str) -> F.Column:
    """The counts a over no more residues than b has."""
    half = F.size(b)
    halves = F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda x, y: F.least(x.cast("int") + y.cast("int"), F.lit(MOST)))
    return F.when(F.size(a) > half, halves).otherwise(F.transform(a, lambda x: x.cast("int")))


def _lacks(a: str, b: str) -> F.Column:
    """A lower bound on the shingles of a that b lacks.  Counts beyond MOST only lower it.  Sets whose
    sizes let them link differ by a factor of two in residues at most."""
    more = F.zip_with(_folded(a, b), _folded(b, a), lambda x, y: F.greatest(x - y, F.lit(0)))
    return F.aggregate(more, F.lit(0), lambda x, y: x + y)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that are frequent in the sample."""

    def run(batches):
        for batch in batches:
            for t in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), words).view(np.int64))], names=["key"])

    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = _texts(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))
    often = some.mapInArrow(run, "key long").groupBy("key").count().filter(F.col("count") >= OFTEN)
    rows = often.orderBy(F.desc("count"), "key").limit(MOST_FREQUENT).collect()
    rows = sorted((r["key"] & (1 << 64) - 1, r["count"]) for r in rows)
    return np.array([k for k, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)


def prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, node (hash of the set), fp (its SimHash), n (its size), counts (by residue), keys (its prefix)."""
    held = docs.sparkSession.sparkContext.broadcast(frequent(docs, words))  # MOST_FREQUENT at most

    def run(batches):
        hashes, often = held.value
        for batch in batches:
            nodes, fps, sizes, residues, keys = [], [], [], [], []
            for t in batch.column(1):
                h = shingles(t.as_py(), words)
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                fps.append(np.packbits(simhash._counts(h) * 2 > len(h), bitorder="little").view(np.int64)[0])
                sizes.append(len(h))
                residues.append(_counts(h))
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    h = h[np.argsort(np.where(hashes[at] == h, often[at], 0), kind="stable")]
                keys.append(h[: len(h) - _least(len(h), similarity) + 1].view(np.int64))
            node = pa.array(np.array(nodes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), node, pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(residues, pa.list_(pa.int8())), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "fp", "n", "counts", "keys"])

    return _texts(docs).mapInArrow(run, "doc_id long, node long, fp long, n long, counts array<tinyint>, keys array<long>")


def similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs u, v (u > v) of nodes that link, checked on the whole sets of shingles."""

    def run(batches):
        for batch in batches:
            for t in batch.column(1):
                h = shingles(t.as_py(), words)
                node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([h.view(np.int64)], pa.list_(pa.int64()))], names=["node", "s"])

    pairs = pairs.distinct()
    for c in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}")).hint("merge"), c)
    most = F.least(F.col("nu") - _lacks("cu", "cv"), F.col("nv") - _lacks("cv", "cu"))
    pairs = checkpoint(pairs.filter(most >= (F.col("nu") + F.col("nv")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)).select("u", "v"))
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    ids = checkpoint(nodes.join(asked.hint("merge"), "node").select("node", F.col("least").alias("_id")))
    texts = _texts(docs)
    texts = texts.join(ids.select("_id").distinct().hint("merge"), texts["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    sets = texts.mapInArrow(run, "node long, s array<long>").join(ids.select("node").hint("merge"), "node", "left_semi")
    sets = checkpoint(sets.dropDuplicates(["node"]))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")).hint("merge"), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")).hint("merge"), "v")
    both = both.withColumn("common", F.size(F.array_intersect("su", "sv")))
    return both.filter(F.col("common") >= (F.size("su") + F.size("sv") - F.col("common")) * F.lit(similarity) - F.lit(1e-9)).select("u", "v")


def covering(docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """u, v (u > v): links between nodes whose fingerprints are equal or differ in at most 2 bits, found by
    anchor covering and checked on the whole sets.  The least node of a fingerprint stands for it."""
    heads = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    met = nodes.join(heads.hint("merge"), "fp").filter("node != head").select("node", "head")
    near = simhash.links(heads.select("fp"))
    for c in ("u", "v"):
        near = near.join(heads.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}")).hint("merge"), c)
    met = met.unionByName(near.select(F.col("hu").alias("node"), F.col("hv").alias("head")))
    return similar(met.select(F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")), docs, nodes, words, similarity)


def bitmaps(asked: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, bits (a bit set for each shingle) and ones (how many are set) of the nodes asked for
    (node, distinct)."""

    def run(batches):
        size = 64 * WORDS_OF_BITS
        for batch in batches:
            names, bits, ones = [], [], []
            for t in batch.column(1):
                h = shingles(t.as_py(), words)
                names.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                on = np.zeros(size, np.uint8)
                on[h & np.uint64(size - 1)] = 1
                bits.append(np.packbits(on).view(np.int64))
                ones.append(int(on.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(bits, pa.list_(pa.int64())), pa.array(ones, pa.int64())], names=["node", "bits", "ones"])

    ids = checkpoint(nodes.join(asked.hint("merge"), "node").select("node", F.col("least").alias("_id")))
    texts = _texts(docs)
    texts = texts.join(ids.select("_id").distinct().hint("merge"), texts["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    found = texts.mapInArrow(run, "node long, bits array<long>, ones long").join(ids.select("node").hint("merge"), "node", "left_semi")
    return checkpoint(found.dropDuplicates(["node"]))


def _pairs(left: DataFrame, right: DataFrame, on: list[str], similarity: float, more: str = "true") -> DataFrame:
    """u, v (u > v) of rows that meet and whose sizes, and bitmaps if they have them, let them link."""
    b = right.select(*on, *(F.col(c).alias(f"{c}_b") for c in right.columns if c not in on))
    met = left.join(b, on).filter("node != node_b").filter(more)
    met = met.filter(F.least("n", "n_b") >= F.greatest("n", "n_b") * F.lit(similarity) - F.lit(1e-9))
    if "bits" in left.columns:
        both = F.bit_count(F.get("bits", F.lit(0)).bitwiseAND(F.get("bits_b", F.lit(0))))
        for k in range(1, WORDS_OF_BITS):
            both = both + F.bit_count(F.get("bits", F.lit(k)).bitwiseAND(F.get("bits_b", F.lit(k))))
        most = F.least(F.col("n") - F.col("ones"), F.col("n_b") - F.col("ones_b")) + both  # what a bit alone stands for isn't common
        met = met.filter(most >= (F.col("n") + F.col("n_b")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))
    return met.select(F.greatest("node", "node_b").alias("u"), F.least("node", "node_b").alias("v"))


def links(docs: DataFrame, nodes: DataFrame, words: int, similarity: float, hot: int) -> DataFrame:
    """u, v: enough links between nodes for the right connected components."""
    close = checkpoint(covering(docs, nodes, words, similarity))
    roots = checkpoint(components(close)).withColumnRenamed("root", "_root")
    at = nodes.join(roots.hint("merge"), "node", "left").select("node", "n", F.coalesce("_root", "node").alias("root"), F.explode("keys").alias("key"))
    at = at.withColumn("held", F.count("*").over(Window.partitionBy("key")))
    at = checkpoint(at.filter("held > 1"))
    cold, busy = at.filter(F.col("held") <= hot), at.filter(F.col("held") > hot)
    found = _pairs(cold, cold, ["key"], similarity, "node > node_b AND root != root_b")
    if busy.isEmpty():
        return close.unionByName(similar(found, docs, nodes, words, similarity))
    busy = checkpoint(busy.join(bitmaps(busy.select("node").distinct(), docs, nodes, words).hint("merge"), "node"))
    blocks = F.pow(F.lit(2.0), F.round(F.log2(F.col("held") / F.lit(BLOCK)))).cast("long")
    dealt = busy.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("block", F.pmod(F.xxhash64("node", "turn"), F.greatest(blocks, F.lit(1))))
    found = found.unionByName(_pairs(dealt, dealt, ["key", "turn", "block"], similarity, "node > node_b AND root != root_b"))
    edges = checkpoint(close.unionByName(similar(found, docs, nodes, words, similarity)))
    roots = checkpoint(components(edges)).withColumnRenamed("root", "_root")
    busy = checkpoint(busy.join(roots.hint("merge"), "node", "left").select("key", "node", "n", "bits", "ones", F.coalesce("_root", "node").alias("root")))
    main = busy.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"))
    open_ = checkpoint(busy.join(main.filter("roots > 1"), "key"))
    rest = _pairs(open_.filter("root != main"), open_, ["key"], similarity, "root != root_b")
    return edges.unionByName(similar(rest, docs, nodes, words, similarity)).distinct()


def near_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable by links, itself included)."""
    marked = checkpoint(prefixes(docs, words, similarity))
    nodes = checkpoint(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("keys").alias("keys")))
    roots = checkpoint(components(links(docs, nodes, words, similarity, hot)))
    named = nodes.join(roots.hint("merge"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "node").join(named.join(names.hint("merge"), "root").select("node", "component_id").hint("merge"), "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """The documents without the later ones of each group."""
    return first_of(docs, near_groups(docs, words, similarity, hot))
