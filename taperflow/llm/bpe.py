"""Byte-level BPE by a pair occurrence index.

New pre-tokens of a batch form one partition-wide symbol chain.  An index maps each adjacent
pair to all its positions; active ranks are taken in ascending order, all positions of the pair
are merged, and only the lists of the neighbouring pairs are updated.  The ids
of each distinct pre-token are kept in a bounded table, so that the encoder then only joins
byte strings.

Defined results: null text is the empty text (0 ids); the special token's string in a text is
one id, as in the library's default; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, slices

CACHE_TOKENS = 800_000
# The published pre-tokenisation pattern of byte-level BPE.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"

# The same for texts of Latin script and common punctuation, with its letters and numerals listed.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_L}{_N}{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
_OTHER = re.compile("[^\0-\u024f\u2010-\u2027\u2030-\u2038\u20ac]")
_CODECS: dict = {}


def printable_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = {b: chr(b) for b in keep}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class PairIndexCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = printable_bytes()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_id = [vocab[c] for c in chars]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(map(back.__getitem__, token))
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.rank = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 17 | vocab[b]] = (r, vocab[a + b])
        self.by_rank = [(pair, new) for pair, (_, new) in self.rank.items()]
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pattern = regex.compile(PATTERN)
        self.ids: dict[str, bytes] = {}

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; one pair occurrence index over all of them."""
        flat = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        start = np.array(self.byte_id, np.int64)[flat]
        start[ends] = -1  # no pair reaches over it
        n = len(start)
        sym, nxt, prv = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank, where, push, pop = self.rank, {}, heapq.heappush, heapq.heappop
        code = start[:-1] << 17 | start[1:]
        code[(start[:-1] < 0) | (start[1:] < 0)] = -1
        order = np.argsort(code, kind="stable")
        kinds, first = np.unique(code[order], return_index=True)
        for c, at in zip(kinds.tolist(), np.split(order, first[1:]), strict=True):
            if c in rank:
                where[c] = at.tolist()
        active = [rank[c][0] for c in where]
        heapq.heapify(active)
        by_rank = self.by_rank
        while active:
            pair, new = by_rank[pop(active)]
            a, b = pair >> 17, pair & 0x1FFFF
            high = new << 17
            for i in sorted(where.pop(pair)):
                if sym[i] != a:
                    continue
                j = nxt[i]
                if sym[j] != b:
                    continue
                k = nxt[j]
                sym[i], sym[j], nxt[i], prv[k] = new, -2, k, i
                p = high | sym[k]
                if p in rank:
                    if p in where:
                        where[p].append(i)
                    else:
                        where[p] = [i]
                        push(active, rank[p][0])
                h = prv[i]
                p = sym[h] << 17 | new
                if p in rank:
                    if p in where:
                        where[p].append(h)
                    else:
                        where[p] = [h]
                        push(active, rank[p][0])
        out, i = [], 0
        for e in ends.tolist():
            ids = []
            while i != e:
                ids.append(sym[i])
                i = nxt[i]
            out.append(ids)
            i += 1
        return out

    def tokens(self, text: str) -> list[str]:
        """Pre-tokens of the published pattern."""
        return (self.pattern if _OTHER.search(text) else _LATIN).findall(text)

    def learn(self, words: list[str]) -> None:
        for w, x in zip(words, self.merge_all([w.encode() for w in words]), strict=True):
            self.ids[w] = pack(f"<{len(x)}I", *x)

    def add(self, new: set[str], again) -> None:
        """Encode pre-tokens that aren't known; if the table is full, start it anew with ``again``."""
        if len(self.ids) + len(new) > CACHE_TOKENS:
            self.ids.clear()
            new = set(again)
        self.learn(list(new))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for k, run in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(pack("<I", self.special[run]))
                continue
            for part in slices(run):
                found = self.tokens(part)
                try:
                    out.append(b"".join(map(self.ids.__getitem__, found)))
                except KeyError:
                    self.add(set(found).difference(self.ids), found)
                    out.append(b"".join(map(self.ids.__getitem__, found)))
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Several short texts: their new pre-tokens share one index."""
        if any(len(t) > 1 << 20 for t in texts) or self.cut and any(map(self.cut.search, texts)):
            return [self.encode(t) for t in texts]
        found = [self.tokens(t) for t in texts]
        seen = set().union(*found)
        if new := seen.difference(self.ids):
            self.add(new, seen)
        return [b"".join(map(self.ids.__getitem__, f)) for f in found]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(path: str) -> PairIndexCodec:
    if path not in _CODECS:
        _CODECS[path] = PairIndexCodec(path)
    return _CODECS[path]


def _groups(column, size: int = 1 << 20):
    """The texts of an Arrow column in lists of bounded size, so that they are never all held."""
    group, held = [], 0
    for x in column:
        t = x.as_py() or ""
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (the text decoded from the ids again)."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1)):
                ids = c.encode_all(group)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])
                at += len(group)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode_documents`` with digests for values,
    so that ids and texts needn't travel back to the JVM."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1)):
                n, ids_sha, text_sha = [], [], []
                for ids in c.encode_all(group):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(group)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
