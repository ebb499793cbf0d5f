"""Harmonic sequence packing.

A piece of length L belongs to the reciprocal class k = capacity // L: exactly k pieces of its
class fit into a bin, whatever their exact lengths.  Every bin of class k is filled with k
pieces, so bins need no look at one another: a piece's bin follows from its running number
within the class (its number within (partition, class) plus the counts of earlier partitions).

Documents may be cut, so lengths are first brought close to a reciprocal of the capacity
(``reciprocal_cuts``): the padding of a full bin is then at most ``slack`` of it.  The last,
incomplete bin of each class (there are at most 2*sqrt(capacity) classes) joins others by
first-fit decreasing on the driver - a table of at most 2*sqrt(capacity) rows.

Defined results: null text is an empty document (only the end id); repeated rows are separate
documents; an empty table gives no rows; extra columns are ignored by the token path and carried
by ``harmonic_pack``, whatever their names but ``sequence_id`` and ``offset``, which it gives; pieces with null or non-positive length, or longer than the capacity, are
an error in ``harmonic_pack``.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import printable_bytes
from .common import WS, checkpoint, fresh, slices, written

CAPACITY = 4096
SLACK = 1 / 64
END_ID = 2
CACHE_TOKENS = 200_000

_WORDS = [i.to_bytes(4, "little") for i in range(1 << 16)]
# The tokenizer's pattern for Latin script and common punctuation, its letters and numerals listed.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(f"[{_L}]+|[{_N}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_L}{_N}{WS}]+")
_OTHER = re.compile("[^\0-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u2038\u20ac]")
_STATE: dict[str, WordEncoder] = {}


def reciprocal_cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths that sum to n; k = capacity // length copies of each waste at most slack*capacity."""
    full, rest = divmod(n, capacity)
    out = [capacity] * full
    while rest:
        k = capacity // rest
        if rest * k >= (1 - slack) * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class WordEncoder:
    """Ids of a text by its pre-tokens; each distinct one is encoded once and kept (bounded table).

    Texts of Latin script are lower-cased and cut here, by the tokenizer's own pattern (it drops
    white space), and only new pre-tokens go to its merge model.  Other texts take its whole way
    (normal forms, other scripts, special tokens)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.ids: dict[str, bytes] = {}
        self.chars = {b: c for b, c in enumerate(printable_bytes()) if chr(b) != c}

    def learn(self, tokens: set[str]) -> None:
        merge, chars, ids = self.merge, self.chars, self.ids
        for t in tokens:
            letters = t if t.isascii() and t.isprintable() else t.encode().decode("latin-1").translate(chars)
            ids[t] = b"".join([_WORDS[x.id] for x in merge(letters)])

    def encode(self, text: str) -> bytes:
        out = []
        for part in slices(text):
            if "<|" in part or _OTHER.search(part):
                out.append(np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes())
                continue
            found = _LATIN.findall(part.lower())
            try:
                out.append(b"".join(map(self.ids.__getitem__, found)))
            except KeyError:
                new = set(found).difference(self.ids)
                if len(self.ids) + len(new) > CACHE_TOKENS:
                    self.ids.clear()
                    new = set(found)
                self.learn(new)
                out.append(b"".join(map(self.ids.__getitem__, found)))
        return b"".join(out)


def encode_text(text: str, tokenizer_path: str) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    if tokenizer_path not in _STATE:
        _STATE[tokenizer_path] = WordEncoder(tokenizer_path)
    return _STATE[tokenizer_path].encode(text)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, slack: float = SLACK, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (array, if kept)."""
    end = np.array([end_id], dtype="<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if keep_ids else []
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode_text(text.as_py() or "", tokenizer_path) + end
                n, at = len(ids) // 4, 0
                for length in reciprocal_cuts(n, capacity, slack):
                    piece = ids[4 * at : 4 * (at + length)]
                    got = (doc_id, at, length, zlib.crc32(piece), n, np.frombuffer(piece, "<i4") if keep_ids else None)
                    for col, v in zip(rows, got, strict=False):
                        col.append(v)
                    at += length
                held += n
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, fields, strict=True)], schema=schema)
                    rows, held = [[] for _ in fields], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, fields, strict=True)], schema=schema)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def first_fit_decreasing(blocks: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """(key, size) -> bin number; a bounded list, so a plain loop."""
    room: list[int] = []
    out = {}
    for key, size in sorted(blocks, key=lambda b: (-b[1], b[0])):
        for i, left in enumerate(room):
            if size <= left:
                room[i] -= size
                out[key] = i
                break
        else:
            out[key] = len(room)
            room.append(capacity - size)
    return out


def harmonic_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id (long, from 0) and offset (long) to rows with a ``length`` in 1..capacity;
    they replace columns of these names.

    The pieces are written once with a number; bins are found for (number, length) alone, in one
    shuffle by (partition, class) and one by sequence for offsets, and joined back by number, so
    that wide columns (ids) are shuffled once.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    pid, mid, kind = fresh(pieces, "_pid", "_mid", "_kind")
    good = (F.col("length") >= 1) & (F.col("length") <= capacity)
    k = F.when(good, F.floor(F.lit(capacity) / F.col("length"))).otherwise(F.raise_error(F.lit("length must be in 1..capacity"))).cast("int")
    whole = written(pieces.withColumns({pid: F.spark_partition_id(), mid: F.monotonically_increasing_id(), kind: k}), "pieces")
    held = whole.select(F.col(pid).alias("pid"), F.col(mid).alias("mid"), F.col(kind).alias("k"), "length")
    counts = checkpoint(held.groupBy("pid", "k").agg(F.count("*").alias("n")))
    totals = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # at most 2*sqrt(capacity) rows
    base, at = {}, 0
    for c in sorted(totals):
        base[c] = at
        at += totals[c] // c
    tail = first_fit_decreasing([(c, (n % c) * (capacity // c)) for c, n in totals.items() if n % c], capacity)
    plan = spark.createDataFrame([(c, base[c], totals[c] // c, at + tail.get(c, 0)) for c in totals], "k int, base long, full long, tail long")
    before = F.sum("n").over(Window.partitionBy("k").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("pid", "k", F.coalesce(before, F.lit(0)).alias("before"))
    placed = held.withColumn("i", F.row_number().over(Window.partitionBy("pid", "k").orderBy("mid")) - 1)
    placed = placed.join(before, ["pid", "k"]).join(F.broadcast(plan), "k").withColumn("i", F.col("i") + F.col("before"))
    b = F.floor(F.col("i") / F.col("k")).cast("long")
    placed = placed.withColumn("sequence_id", F.when(b < F.col("full"), F.col("base") + b).otherwise(F.col("tail")))
    w = Window.partitionBy("sequence_id").orderBy("k", "i").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(F.col("mid").alias(mid), "sequence_id", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"))
    return whole.join(placed, mid).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence_id and offset."""
    return harmonic_pack(token_pieces(docs, tokenizer_path, capacity, keep_ids=keep_ids), capacity)
