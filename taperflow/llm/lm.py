"""Language-model scores by deleted interpolation.

log10 P(text) = sum over tokens of log10(l2[b] * c(h,w)/c(h) + l1[b] * c(w)/N + l0[b] / (V+1)),
b the bucket of the context's frequency c(h) (powers of two, bucket 0: never seen).  The three
weights of each bucket are learned by expectation-maximisation on held-out counts: every training
token is held out in turn, so its own count is deleted from c(h,w), c(h), c(w) and N.

Data flow.  Texts are read once.  Tokens are numbered within chunks of at most ``CHUNK`` tokens
(long texts are split between chunks) and a chunk keeps its distinct words as 64-bit hashes, and
its tokens as numbers of these - a written table.  Each chunk sends the hashes of its distinct
words and word pairs with their training counts, as packed arrays, up a tree of merges: a node
stands for a range of the hash space and a group of chunks, sums the equal hashes of at most
about ``FAN`` children, and sends each part of its range on to a node of more chunks, until a
node stands for all chunks and has totals.  The totals come back down the same tree, to each
child in the order asked.  So a node holds about as many hashes as a chunk however large the
input is, a level has at most ``FAN`` rows a chunk, and levels grow with the logarithm of the
number of chunks.  A word or pair counts once a chunk in the shuffle, however frequent.
Held-out pairs of relative frequencies are counted on a logarithmic grid for the weights, which
reaches down to 1/N.

A context's frequency is its frequency as a word (each token but the end is a context once), and
that of the start is that of the end, so only words and pairs are asked for.

Counts cover the whole training part and grow with it; nothing is cut off.  Words and pairs are
told apart by the first node's range and 48 more bits of a hash.

Defined results: null text is the empty text (one end token); repeated rows are scored each, and
count each; with no training token at all every score is that of the uniform part over one word;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, written

CHUNK = 500_000
FAN = 512  # children of a merge node, and parts of its range
STEP = 0.25  # log2 of the ratio of neighbouring cells of a relative frequency
EM_ROUNDS = 200

START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes."""
    x = (h ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ x >> np.uint64(32)) + w
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


class _Chunk:
    """Distinct words (hashes) and the tokens as numbers of them; 0 is the start, 1 the end."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = lambda d=self.number: len(d) + 2
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple] = []  # row, doc_id, training, number of tokens
        self.size = 0

    def add(self, row: int, doc_id: int | None, training: bool, before: bytes | None, words: list[bytes], last: bool) -> None:
        first = 0 if before is None else self.number[before]
        ids = np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words))
        self.parts += [np.array([first], np.uint32), ids, np.array([1] * last, np.uint32)]
        self.docs.append((row, doc_id, training, len(words) + last))
        self.size += len(words) + last + 1

    def row(self, name: int) -> list:
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.number), np.uint64, len(self.number))
        rows, ids, training, sizes = zip(*self.docs, strict=True)
        return [name, np.array(rows, "<i8").tobytes(), list(ids), np.array(training, np.uint8).tobytes(), np.array(sizes, "<u4").tobytes(), _packed(np.concatenate(self.parts).astype("<u4")), np.concatenate([[START, END], hashes]).astype("<u8").tobytes()]


STATE = "chunk long, rows binary, ids array<long>, training binary, sizes binary, tokens binary, words binary"


def chunks(docs: DataFrame, training: F.Column, chunk: int = CHUNK) -> DataFrame:
    """The texts as chunks (columns STATE)."""
    fields = [("chunk", pa.int64()), ("rows", pa.binary()), ("ids", pa.list_(pa.int64())), ("training", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary())]

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        row = made = 0
        now = _Chunk()

        def flush():
            got = now.row(base + made)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(got, fields, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            for doc_id, text, learn in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                parts, before = [*slices(text.as_py() or "", ascii_spaces=True)], None
                for k, part in enumerate(parts):
                    words = part.encode("utf-8", "surrogatepass").lower().split()
                    now.add(base + row, doc_id, bool(learn), before, words, k == len(parts) - 1)
                    before = words[-1] if words else before
                    if now.size >= chunk:
                        yield flush()
                        made, now = made + 1, _Chunk()
                row += 1
        if now.docs:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), training).mapInArrow(run, STATE)


def _tokens(rec: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, context, word) of each token, as numbers in the chunk."""
    tokens, sizes = _unpacked(rec["tokens"], "<u4"), np.frombuffer(rec["sizes"], "<u4").astype(np.int64)
    keep = np.ones(len(tokens), bool)
    keep[np.cumsum(sizes + 1) - sizes - 1] = False  # each document part begins with a context
    at = np.flatnonzero(keep)
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), tokens[at - 1], tokens[at]


class _State:
    """A chunk's distinct words and pairs, each with its training count here."""

    def __init__(self, rec: dict):
        self.chunk = rec["chunk"]
        self.words = np.frombuffer(rec["words"], "<u8")
        doc, context, word = _tokens(rec)
        code = context.astype(np.int64) * len(self.words) + word
        codes, self.pair = np.unique(code, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        self.pair_context, self.pair_word = (codes // len(self.words)).astype(np.int32), (codes % len(self.words)).astype(np.int32)
        learn = np.frombuffer(rec["training"], np.uint8).astype(bool)[doc]
        self.word_count = np.bincount(word[learn], minlength=len(self.words))
        self.pair_count = np.bincount(self.pair[learn], minlength=len(codes))
        self.word_order = np.argsort(self.words)
        self.pairs = _mix(self.words[self.pair_context], self.words[self.pair_word])
        self.pair_order = np.argsort(self.pairs)


def _parts(keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where each part of a range begins in sorted keys."""
    return np.concatenate([[0], np.searchsorted(keys, edges[1:]), [len(keys)]])


def _edges(parts: int, bits: int) -> np.ndarray:
    return np.array([(b << bits) // parts for b in range(parts)], np.uint64)


def _short(keys: np.ndarray) -> bytes:
    """Keys of 48 bits."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(raw: bytes) -> np.ndarray:
    x = np.zeros((len(raw) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return x.view("<u8")[:, 0]


def _each_state(batches):
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


def _varint(x: np.ndarray) -> bytes:
    """Counts in 1 byte, or 255 and 8 bytes."""
    big = x >= 255
    return np.array([len(x)], "<u8").tobytes() + np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype("<u8").tobytes()


def _counts(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    x = np.frombuffer(raw, np.uint8, n, 8).astype(np.uint64)
    x[x == 255] = np.frombuffer(raw, "<u8", offset=8 + n)
    return x


ASKED = "node long, grp long, child long, part int, words binary, word_counts binary, pairs binary, pair_counts binary"


def _asking(node: int, grp: int, child: int, parts: int, bits: int, words: np.ndarray, nw: np.ndarray, pairs: np.ndarray, np_: np.ndarray) -> dict:
    """Columns ASKED of what a child asks: its sorted keys cut into the parts of its range, relative
    to their edges.  node numbers the range; grp names the group of chunks on the next level."""
    edges = _edges(parts, bits)
    drop = np.uint64(max(0, bits - (parts.bit_length() - 1) - 48))
    cw, cp = _parts(words, edges), _parts(pairs, edges)
    full = np.flatnonzero((np.diff(cw) > 0) | (np.diff(cp) > 0))
    cut = lambda keys, c, b: _short(keys[c[b] : c[b + 1]] - edges[b] >> drop)
    blobs = [(cut(words, cw, b), _varint(nw[cw[b] : cw[b + 1]]), cut(pairs, cp, b), _varint(np_[cp[b] : cp[b + 1]])) for b in full]
    same = lambda v: pa.array(np.full(len(full), v), pa.int64())
    columns = zip(*blobs, strict=True) if blobs else [()] * 4
    names = [x.split()[0] for x in ASKED.split(", ")]
    return dict(zip(names, [pa.array(node * parts + full, pa.int64()), same(grp), same(child), pa.array(full, pa.int32()), *(pa.array(list(c), pa.binary()) for c in columns)], strict=True))


def _group(name: int, groups: int) -> int:
    """The group of a child on the next level, spread evenly."""
    return xxhash.xxh3_64_intdigest(name.to_bytes(8, "little", signed=True)) % groups


def requests(state: DataFrame, parts: int, groups: int) -> DataFrame:
    """ASKED by the chunks: keys and counts of their distinct words and pairs."""

    def run(batches):
        for rec in _each_state(batches):
            s = _State(rec)
            w, p = s.word_order, s.pair_order
            yield pa.RecordBatch.from_pydict(_asking(0, _group(s.chunk, groups), s.chunk, parts, 64, s.words[w], s.word_count[w], s.pairs[p], s.pair_count[p]))

    return state.mapInArrow(run, ASKED)


def _merged(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The distinct keys of all children in order, their totals, each child's places among them,
    and where the children end."""
    held = [_long(k) for k in keys]
    distinct, at = np.unique(np.concatenate(held), return_inverse=True)
    # Weights are doubles: exact to 2**53.
    total = np.bincount(at, weights=np.concatenate([_counts(c) for c in counts]), minlength=len(distinct)).astype(np.uint64)
    return distinct, total, at, np.cumsum([len(k) for k in held])[:-1].tolist()


def _node(t: pa.Table) -> tuple:
    """(child's column, merged words, merged pairs) of a node's rows in a fixed order."""
    t = t.sort_by("child")
    merged = [_merged(t.column(k).to_pylist(), t.column(c).to_pylist()) for k, c in (("words", "word_counts"), ("pairs", "pair_counts"))]
    return t, *merged


def _name(node: int, grp: int, groups: int) -> int:
    return node * groups + grp


def merge(asked: DataFrame, groups: int, parts: int, above: int) -> DataFrame:
    """ASKED by the nodes of a level that has ``groups`` groups, of one that has ``above``."""

    def run(t):
        _, words, pairs = _node(t)
        node, grp = t.column("node")[0].as_py(), t.column("grp")[0].as_py()
        return pa.table(_asking(node, grp % above, _name(node, grp, groups), parts, 48, words[0], words[1], pairs[0], pairs[1]))

    return asked.groupBy("node", "grp").applyInArrow(run, ASKED)


ANSWER = "child long, part int, words binary, pairs binary, tokens long, distinct long"


def _answer(t: pa.Table, words: tuple, pairs: tuple, word_total: np.ndarray, pair_total: np.ndarray, tokens: int, distinct: int) -> pa.Table:
    rest = [0] * (len(t) - 1)
    back = lambda m, total: pa.array([_varint(x) for x in np.split(total[m[2]], m[3])], pa.binary())
    return pa.table({"child": t.column("child"), "part": t.column("part"), "words": back(words, word_total), "pairs": back(pairs, pair_total), "tokens": pa.array([tokens, *rest], pa.int64()), "distinct": pa.array([distinct, *rest], pa.int64())})


def answers(asked: DataFrame) -> DataFrame:
    """ANSWER of the nodes that stand for all chunks: totals of each child's keys, and once a node
    its tokens (N) and distinct words (V)."""

    def run(t):
        t, words, pairs = _node(t)
        return _answer(t, words, pairs, words[1], pairs[1], int(words[1].sum()), int((words[1] > 0).sum()))

    return asked.groupBy("node").applyInArrow(run, ANSWER)


def _received(t: pa.Table, words: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals by sorted key from the answers to all parts of a range."""
    t = t.sort_by("part")
    got = [np.concatenate([np.zeros(0, np.uint64), *(_counts(x) for x in t.column(c).to_pylist())]) for c in ("words", "pairs")]
    assert len(got[0]) == words and len(got[1]) == pairs, "an answer is missing"
    return got[0], got[1]


def relay(asked: DataFrame, answered: DataFrame, groups: int) -> DataFrame:
    """ANSWER to the children of a level's nodes from what these were answered themselves."""

    def run(left, right):
        t, words, pairs = _node(left)
        word_total, pair_total = _received(right, len(words[0]), len(pairs[0]))
        return _answer(t, words, pairs, word_total, pair_total, 0, 0)

    own = asked.withColumn("name", F.col("node") * groups + F.col("grp"))
    return own.groupBy("name").cogroup(answered.withColumnRenamed("child", "name").groupBy("name")).applyInArrow(run, ANSWER)


def totals(state: DataFrame, count: int, fan: int = FAN) -> tuple[DataFrame, int, int]:
    """(ANSWER to the chunks, N, V); count: the number of chunks."""
    parts, groups = min(fan, max(8, count)), max(1, -(-count // fan))
    asked, levels = requests(state, parts, groups), []
    while groups > 1:
        asked = written(asked, "lm-asked")
        levels.append((asked, groups))
        above = -(-groups // fan)
        asked, groups = merge(asked, groups, min(fan, groups), above), above
    answered = written(answers(asked), "lm-totals")
    n, v = answered.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    for asked, groups in reversed(levels):
        last, answered = answered, written(relay(asked, answered, groups), "lm-totals")
        discard(asked, last)
    return answered, n, v


KNOWN = "chunk long, rows binary, ids array<long>, training binary, sizes binary, tokens binary, word_total binary, pair_total binary, grid array<struct<cell:int,weight:double>>"


def _buckets(n: int) -> int:
    """Of context frequencies, by powers of two, that n tokens can have."""
    return 2 + max(0, n).bit_length()


def _bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2)."""
    return np.where(count > 0, 1 + np.log2(np.maximum(count, 1)).astype(np.int64), 0)


def _grid(n: int) -> int:
    """Cells of a relative frequency: 0, and the powers of 2**STEP from 1 down to 1/n."""
    return 2 + int(np.ceil(np.log2(max(2, n)) / STEP))


def _cell(f: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + the number of steps below 1."""
    return np.where(f > 0, 1 + np.round(-np.log2(np.where(f > 0, f, 1)) / STEP).astype(np.int64), 0)


def _value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 2.0 ** (-(cell - 1) * STEP), 0.0)


def _context_total(word_total: np.ndarray) -> np.ndarray:
    """By word number; the start (0) is as frequent as the end (1)."""
    out = word_total.copy()
    out[0] = out[1]
    return out


def known(state: DataFrame, answered: DataFrame, n: int) -> DataFrame:
    """Each chunk with the totals it asked for, and its held-out counts on the grid."""
    wide = _grid(n)

    def run(left, right):
        rec = left.slice(0, 1).to_pylist()[0]
        s = _State(rec)
        word_total, pair_total = np.empty(len(s.words), np.int64), np.empty(len(s.pairs), np.int64)
        word_total[s.word_order], pair_total[s.pair_order] = _received(right, len(s.words), len(s.pairs))
        on = np.flatnonzero(s.pair_count)
        ch, cw, chw, weight = _context_total(word_total)[s.pair_context[on]] - 1, word_total[s.pair_word[on]] - 1, pair_total[on] - 1, s.pair_count[on]
        f2, f1 = chw / np.maximum(ch, 1), cw / max(1, n - 1)
        cells, at = np.unique((_bucket_of(ch) * wide + _cell(f2)) * wide + _cell(f1), return_inverse=True)
        grid = [{"cell": c, "weight": w} for c, w in zip(cells.tolist(), np.bincount(at, weights=weight, minlength=len(cells)).tolist(), strict=True)]
        out = [s.chunk, rec["rows"], rec["ids"], rec["training"], rec["sizes"], rec["tokens"], _varint(word_total), _varint(pair_total[s.pair]), grid]
        types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.list_(pa.struct([("cell", pa.int32()), ("weight", pa.float64())]))]
        return pa.table({k.split()[0]: pa.array([v], t) for k, v, t in zip(KNOWN.split(", "), out, types, strict=True)})

    return state.groupBy("chunk").cogroup(answered.withColumnRenamed("child", "chunk").groupBy("chunk")).applyInArrow(run, KNOWN)


def learn_weights(grid: list[tuple[int, float]], n: int, v: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (l2, l1, l0) of each bucket by expectation-maximisation; rows without held-out
    counts take those of all buckets together."""
    wide, buckets = _grid(n), _buckets(n)
    cell = np.array([c for c, _ in grid], np.int64)
    weight = np.array([w for _, w in grid])
    bucket = cell // (wide * wide)
    parts = np.stack([_value(cell // wide % wide), _value(cell % wide), np.full(len(cell), 1 / (v + 1))], axis=1)

    def em(p: np.ndarray, w: np.ndarray, pair: bool) -> np.ndarray:
        lam = np.array([0.4, 0.4, 0.2]) if pair else np.array([0.0, 0.7, 0.3])
        for _ in range(rounds):
            joint = p * lam
            lam = (joint / joint.sum(axis=1, keepdims=True) * w[:, None]).sum(axis=0) / w.sum()
            lam = np.maximum(lam, [1e-9 * pair, 1e-9, 1e-9])
            lam /= lam.sum()
        return lam

    every = em(parts, weight, True) if len(cell) else np.array([0.4, 0.4, 0.2])
    out = np.tile(every, (buckets, 1))
    out[0] = [0, every[1] / (every[1] + every[2]), every[2] / (every[1] + every[2])]
    for b in range(buckets):
        if (on := bucket == b).any():
            out[b] = em(parts[on], weight[on], b > 0)
    return out


def score(held: DataFrame, weights: np.ndarray, n: int, v: int) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, base_score, score of each part of a document."""

    def run(batches):
        for rec in _each_state(batches):
            sizes = np.frombuffer(rec["sizes"], "<u4").astype(np.int64)
            doc, context, word = _tokens(rec)
            word_total = _counts(rec["word_total"]).astype(np.int64)
            cw, ch, chw = word_total[word], _context_total(word_total)[context], _counts(rec["pair_total"]).astype(np.int64)
            lam = weights[_bucket_of(ch)]
            p = lam[:, 0] * chw / np.maximum(ch, 1) + lam[:, 1] * cw / max(1, n) + lam[:, 2] / (v + 1)
            total = lambda x: np.bincount(doc, weights=x, minlength=len(sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(rec["rows"], "<i8")), pa.array(rec["ids"], pa.int64()), pa.array(np.frombuffer(rec["training"], np.uint8) == 0), pa.array(sizes), pa.array(total(cw > 0).astype(np.int64)), pa.array(total(np.log10((cw + 1) / (n + v + 1)))), pa.array(total(np.log10(p)))],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return held.drop("grid").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, held_out: F.Column, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, per row of docs; rows
    for which ``held_out`` holds (or is null) aren't learned from."""
    learn = ~F.coalesce(held_out, F.lit(True))
    state = written(chunks(docs, learn.alias("training"), chunk), "lm-chunks")
    answered, n, v = totals(state, state.count(), fan)
    held = written(known(state, answered.select("child", "part", "words", "pairs"), n), "lm-known")
    discard(state, answered)
    grid = held.select(F.explode("grid").alias("g")).groupBy("g.cell").agg(F.sum("g.weight").alias("w"))  # at most _buckets * _grid**2 rows
    weights = learn_weights([(r[0], r[1]) for r in grid.collect()], n, v)
    parts = score(held, weights, n, v)
    whole = parts.groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "held_out")), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
