"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

Dimensions: language, source, size and doc_id, each scaled to 0 .. 2**16-1 over the whole table's
range (size by its logarithm, a language or source by its checksum), so that widths can be compared.
A node that stands for m shards is cut along its widest dimension so that floor(m/2)/m of its bytes
go left: a weighted median, or the quantile next to it where m is odd.  Rows with equal coordinates
are told apart by a checksum of their text, then of their id, then by their place in the table, so a
hot value can be cut anywhere and leaves reach the target bytes.

The cuts of all nodes of a level are found together, in passes over 16 bits of the 63-bit key:
bytes are summed by (node, digits), running sums over a node's digits (65,536 at most) find those
in which the wanted bytes are reached, and one row a node comes to the driver.  A row's node is an
expression over the cuts so far (one comparison a cut), so rows are never rewritten.

Law ``bytes``: the shards' sizes are near equal.  Equal texts with equal metadata stay together
wherever no cut falls among them.

Defined results: null text has no bytes (size 8) and checksum 0; a null doc_id, language or
source is a value like any other; repeated rows are rows of their own; with fewer rows than
shards some shards stay empty; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SHARDS = 24
OVERHEAD = 8
DIMENSIONS = ("lang", "source", "bytes", "id")
BITS = 16
#: The lowest bits of the key's digits, highest first: coordinate, text, id and place.
DIGITS = (47, 31, 15, 0)
#: Rows of a shard that one task numbers.
PER_TASK = 100_000


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tie (47 bits: text, id, place), and a coordinate (0 .. 2**16-1)
    per dimension."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    crc = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("\0")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), crc(F.col("lang")).alias("lang"), crc(F.col("source")).alias("source"), F.monotonically_increasing_id().alias("place"))
    rows = checkpoint(rows.withColumns({"bytes": F.log2(F.col("size").cast("double")), "id": F.coalesce("doc_id", F.lit(0))}))
    low_high = rows.agg(*(f(F.col(c).cast("double")).alias(f"{f.__name__}_{c}") for c in DIMENSIONS for f in (F.min, F.max))).first()

    def scaled(c):
        low, high = low_high[f"min_{c}"], low_high[f"max_{c}"]
        if low is None or low == high:
            return F.lit(0).cast("long")
        return F.floor((F.col(c).cast("double") - low) / (high - low) * (2**BITS - 1)).cast("long")

    tie = F.shiftleft(F.shiftright("text_crc32", 16), 31) + F.shiftleft(F.shiftright(crc(F.concat_ws(",", F.lit("tie"), "doc_id")), 16), 15) + F.pmod(F.xxhash64("place"), F.lit(1 << 15))
    return rows.select("doc_id", "size", "text_crc32", tie.alias("tie"), *(scaled(c).alias(c) for c in DIMENSIONS))


def _by_node(values: dict[int, object]) -> Column:
    """The value of the row's node, null for others: a table of at most a row a shard."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("node"))


def _key(dimension: str) -> Column:
    return F.shiftleft(dimension, 47) + F.col("tie")


def _find_cuts(rows: DataFrame, wanted: dict[int, float]) -> dict[int, int]:
    """For each node the key K of which the bytes of rows with key <= K come nearest to what is
    wanted, ties to the smaller; rows: node, key, size."""
    prefix, below = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0)
    for last, shift in zip((None, *DIGITS), DIGITS, strict=False):
        on = F.lit(True) if last is None else F.shiftright("key", last) == _by_node(prefix)
        sums = rows.filter(on).groupBy("node", F.shiftright("key", shift).alias("digits")).agg(F.sum("size").alias("size"))
        to = F.sum("size").over(Window.partitionBy("node").orderBy("digits")) + _by_node(below)
        reached = sums.withColumn("to", to).filter(F.col("to") >= _by_node({k: float(w) for k, w in wanted.items()})).groupBy("node").agg(F.min(F.struct("digits", "to", "size")).alias("r"))
        for r in reached.collect():  # a row a node
            k, (digits, upto, size) = r["node"], r["r"]
            prefix[k], below[k] = digits, upto - size
            if shift == 0 and upto - wanted[k] >= wanted[k] - below[k]:
                prefix[k] -= 1
    return prefix


def _node(cuts: dict[int, list[tuple[str, int, int]]], first: int = 0, depth: int = 0) -> Column:
    """The node of a row: cuts has for each node, by its first shard, the (dimension, key, first
    shard of the right side) of its cuts from the root on."""
    if len(cuts.get(first, ())) <= depth:
        return F.lit(first)
    dimension, key, right = cuts[first][depth]
    return F.when(_key(dimension) <= key, _node(cuts, first, depth + 1)).otherwise(_node(cuts, right))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = checkpoint(metadata(docs))
    cuts: dict[int, list[tuple[str, int, int]]] = {}
    leaves = {0: shards}  # nodes are named by their first shard
    while any(m > 1 for m in leaves.values()):
        at = rows.withColumn("node", _node(cuts))
        ranges = [f(c).alias(f"{f.__name__}_{c}") for c in DIMENSIONS for f in (F.min, F.max)]
        seen = {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("size"), *ranges).collect()}
        split = [k for k, m in leaves.items() if m > 1 and k in seen]
        if not split:
            break
        widest = {k: max(DIMENSIONS, key=lambda c, r=seen[k]: (r[f"max_{c}"] - r[f"min_{c}"], -DIMENSIONS.index(c))) for k in split}
        key = F.shiftleft(F.get(F.array(*DIMENSIONS), _by_node({k: DIMENSIONS.index(c) for k, c in widest.items()})), 47) + F.col("tie")
        found = _find_cuts(at.filter(F.col("node").isin(split)).select("node", key.alias("key"), "size"), {k: seen[k]["size"] * (leaves[k] // 2) / leaves[k] for k in split})
        for k in split:
            cuts.setdefault(k, []).append((widest[k], found[k], k + leaves[k] // 2))
        leaves = {n: m for k, whole in leaves.items() if k in split for n, m in ((k, whole // 2), (k + whole // 2, whole - whole // 2))}
    return numbered(rows.select("doc_id", "size", "text_crc32", _node(cuts).cast("int").alias("shard")))


def numbered(rows: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """Gapless slots within each shard, numbered by parts of bounded size."""
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 + most // per_task)))
    counts = rows.groupBy("shard", "_part").count()
    before = counts.select("shard", "_part", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    slot = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32")) - 1
    out = rows.withColumn("_slot", slot).join(before, ["shard", "_part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_slot") + F.col("_before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
