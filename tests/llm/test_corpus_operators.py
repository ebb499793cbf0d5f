"""Near-dedup, LM, line dedup, sharding, neighbours, language ID and toxicity by brute force."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from taperflow.llm import ann, langid, linededup, lm, queries, sharding, simhash, toxicity
from taperflow.llm.common import doc_crc32, near_first

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _t string, _later int, fp string, lines_removed string"


def frame(spark, texts, langs=None):
    rows = [(k, t, langs[k] if langs else "en", "s", len(t or ""), "x", 1, "f", "r") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rnd, n, pool=400):
    return " ".join(f"w{rnd.randrange(pool)}" for _ in range(n))


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(ids, fps):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, i in enumerate(ids)}


def test_near_groups(spark):
    rnd = random.Random(5)
    base = [words(rnd, 120) for _ in range(12)]
    texts = [*base, *(b.replace(b.split()[k], "new", 1) for k, b in enumerate(base)), *base[:4], base[0] + " tail", "", None, "  ", "one", "one two", "ONE two", "a" * 50_000, "x y z " * 3000]
    got = {r["doc_id"]: r for r in simhash.near_groups(frame(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[k]["fp"] & (1 << 64) - 1 for k in range(len(texts))] == fps
    assert {k: r["component_id"] for k, r in got.items()} == brute_groups(range(len(texts)), fps)
    kept = {r["doc_id"] for r in simhash.keep_first(frame(spark, texts)).collect()}
    assert kept == set(brute_groups(range(len(texts)), fps).values())


@pytest.mark.parametrize("crowded", [False, True])
def test_links_lose_no_pair(spark, crowded):
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    if crowded:  # one large group of words that differ in a few bits of either half
        fps |= {sum(rnd.getrandbits(1) << b for b in (0, 1, 5, 13, 17, 30, 31, 33, 47, 48, 62, 63)) for _ in range(700)}
    for f in [*fps][:40]:
        for _ in range(4):
            f ^= 1 << rnd.randrange(64)
            fps.add(f)
            fps.add(f ^ 1 << rnd.randrange(64))
    fps = sorted(f - (f >> 63 << 64) for f in fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert {tuple(sorted(r)) for r in edges.collect()} == {(b, a) for k, a in enumerate(fps) for b in fps[:k] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = brute_groups(fps, [f & (1 << 64) - 1 for f in fps])
    assert {f: got.get(f, f) for f in fps} == want


def test_anchors_compare_few_of_a_crowd(spark):
    fps = [(a << 32 | a * 7 & 0xFFFFFFFF, "x") for a in range(1, 3000)]
    at = simhash.at_anchors(spark.createDataFrame(fps, "fp long, x string").select("fp"))
    assert at.count() <= 38 * len(fps)
    assert at.groupBy("code", "key", "block").count().agg(F.max("count")).first()[0] < 200


def test_components_of_a_long_chain(spark):
    n = 500
    edges = spark.createDataFrame([(k * 7 % n, (k + 1) * 7 % n) for k in range(n - 1)], "a long, b long").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_near_groups_of_nothing_and_repeated_rows(spark):
    assert simhash.near_groups(frame(spark, [])).count() == 0
    docs = frame(spark, ["a b c d e", "a b c d e"]).unionByName(frame(spark, ["a b c d e"]))
    assert {r["component_id"] for r in simhash.near_groups(docs).collect()} == {0}
    assert simhash.keep_first(docs).count() == 1


def expect(events, n, v, rounds=200):
    """Weights by expectation-maximisation on the held-out events themselves."""
    parts = np.array([[f2, f1, 1 / (v + 1)] for f2, f1 in events])
    lam = np.array([0.4, 0.4, 0.2])
    for _ in range(rounds):
        joint = parts * lam
        lam = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
    return lam


@pytest.mark.parametrize(("chunk", "fan"), [(40, 3), (40, 512), (500_000, 512)])
def test_language_model(spark, chunk, fan):
    rnd = random.Random(1)
    texts = [words(rnd, rnd.randrange(1, 60), 30) for _ in range(60)] + ["", None, "Same Same same", "Same Same same", "a b " * 2000]
    held = [k % 5 == 3 for k in range(len(texts))]
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            for a, b in zip(["start", *t], t, strict=False):
                uni[b] += 1
                bi[a, b] += 1
                ctx[a] += 1
    n, v = sum(uni.values()), len(uni)
    seen = []
    learn = lm.learn_weights
    lm.learn_weights = lambda *a, **kw: seen.append(learn(*a, **kw)) or seen[-1]
    try:
        got = {r["doc_id"]: r for r in lm.score_documents(frame(spark, texts), F.col("doc_id") % 5 == 3, chunk, fan).collect()}
    finally:
        lm.learn_weights = learn
    w = seen[0]
    assert np.allclose(w.sum(axis=1), 1)
    events = collections.defaultdict(list)
    for (a, b), c in bi.items():
        events[1 + int(math.log2(ctx[a] - 1)) if ctx[a] > 1 else 0] += [((c - 1) / max(1, ctx[a] - 1), (uni[b] - 1) / (n - 1))] * c
    for bucket, e in events.items():
        if bucket:
            mine, best = (np.log(np.array([[*x, 1 / (v + 1)] for x in e]) @ lam).mean() for lam in (w[bucket], expect(e, n, v)))
            assert mine > best - 0.005
    for k, t in enumerate(tokens):
        r = got[k]
        p = base = 0.0
        for a, b in zip(["start", *t], t, strict=False):
            lam = w[0 if not ctx[a] else 1 + int(math.log2(ctx[a]))]
            p += math.log10(lam[0] * bi[a, b] / max(1, ctx[a]) + lam[1] * uni[b] / n + lam[2] / (v + 1))
            base += math.log10((uni[b] + 1) / (n + v + 1))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(t), sum(uni[x] > 0 for x in t), n)
        assert math.isclose(r["score"], p, rel_tol=1e-9) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    assert lm.score_documents(frame(spark, []), doc_crc32() % 7 == 2).count() == 0


def test_rare_words_of_a_large_corpus_keep_their_frequency():
    for n in (10**3, 10**8, 10**15):  # the grid reaches down to 1 / n
        f = np.array([1 / n, 3 / n, 1.0, 0.0])
        cell = lm._cell(f)
        assert cell.max() < lm._grid(n) and cell[3] == 0
        assert np.all(np.abs(np.log2(lm._value(cell)[:3] / f[:3])) <= lm.STEP / 2 + 1e-9)
        assert lm._bucket_of(np.array([n]))[0] < lm._buckets(n)


def passages(rnd):
    p = [[words(rnd, rnd.randrange(8, 40)) for _ in range(5)] for _ in range(4)]
    own = lambda: [words(rnd, rnd.randrange(1, 30)) for _ in range(rnd.randrange(0, 6))]
    docs = ["\n".join([*own(), *p[k % 4], *own()]) for k in range(14)]
    docs += [docs[0], docs[0] + "\nmore", "short line\nshort line", "\n\n", "", None, words(rnd, 60) + "\n" + words(rnd, 5), "\n".join([words(rnd, 70)] * 6)]
    return docs + ["\n".join(words(rnd, 12) for _ in range(3000))]


def test_line_dedup_equals_sql_and_keeps_first(spark):
    texts = passages(random.Random(9))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = {r[0]: r[1:] for r in con.execute(linededup.ORACLE).fetchall()}
    assert {k: (r["text"], r["lines_removed"]) for k, r in got.items()} == want
    first = {}
    for k, t in enumerate(texts):
        for x in (t or "").split("\n"):
            first.setdefault(x, k)
    for line, k in first.items():  # the first copy of every line stays
        if texts[k]:
            assert line in got[k]["text"].split("\n")
    for k in range(4, 14):  # passages of over 50 words go from later documents
        kept = got[k]["text"].split("\n")
        assert not set(texts[k].split("\n")) & set(texts[k % 4].split("\n")) & set(kept) - {""}
    assert got[14]["text"] == "" and got[16]["text"] == texts[16] and got[19]["text"] is None
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def brute_tree(rows, shards):
    """Shard of each row (size, tie, coordinates) by recursion on lists."""
    out = {}

    def split(part, first, m):
        if m == 1 or not part:
            out.update((k, first) for k in part)
            return
        width = lambda d: max(rows[k][d] for k in part) - min(rows[k][d] for k in part)
        d = max(sharding.DIMENSIONS, key=lambda d: (width(d), -sharding.DIMENSIONS.index(d)))
        key = lambda k: (rows[k][d] << 47) + rows[k]["tie"]
        goal = sum(rows[k]["size"] for k in part) * (m // 2) / m
        best, upto = None, 0
        keys = sorted({key(k) for k in part})
        sums = collections.Counter()
        for k in part:
            sums[key(k)] += rows[k]["size"]
        cut = None
        for x in keys:
            if upto + sums[x] >= goal:
                cut = x if upto + sums[x] - goal < goal - upto else x - 1
                break
            upto += sums[x]
        split([k for k in part if key(k) <= cut], first, m // 2)
        split([k for k in part if key(k) > cut], first + m // 2, m - m // 2)

    split(list(range(len(rows))), 0, shards)
    return out


def test_shards(spark):
    rnd = random.Random(4)
    texts = [words(rnd, rnd.randrange(1, 300)) for _ in range(600)] + ["hot text " * 40] * 400 + [None, ""]
    langs = [rnd.choice(["en", "de", None]) for _ in texts]
    docs = frame(spark, texts, langs)
    got = sharding.assign(docs).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(texts) and sorted(sizes) == list(range(24))
    mean = sum(sizes.values()) / 24
    assert max(sizes.values()) - min(sizes.values()) < 0.15 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(frame(spark, [])).count() == 0
    few = sharding.assign(frame(spark, ["a", "a", None])).collect()
    assert len(few) == 3 and all(0 <= r["shard"] < 24 for r in few)


def test_repeated_rows_can_be_cut_apart(spark):
    one = frame(spark, ["same text again"])
    docs = one.crossJoin(spark.range(0, 960, 1, 4).select()).select(one.columns)
    sizes = [r["n"] for r in sharding.assign(docs).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 24 and min(sizes) >= 35 and max(sizes) <= 45


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shards_equal_a_tree_by_recursion(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = [r.asDict() for r in sharding.metadata(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    want = brute_tree(rows, 24)
    got = {r["doc_id"]: r["shard"] for r in queries.op5_kd_tree(spark, sf).collect()}
    assert got == {r["doc_id"]: want[k] for k, r in enumerate(rows)}


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((600, 16)).astype(np.float32)
    v[500:560] = v[0]  # many copies
    v[560] = 2 * v[0]
    rows = [(k, x.tolist(), "e") for k, x in enumerate(v)] + [(900, None, "e"), (950, [0.0] * 16, "e"), (1000, [float("nan")] + [1.0] * 15, "e"), (1050, [1.0] * 3, "e"), (1100, [None] + [1.0] * 15, "e"), (0, v[0].tolist(), "e"), (None, v[1].tolist(), "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, e string")
    from pyspark.sql import functions as F

    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 600, 50))
    hits = total = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        s = u @ u[q]
        assert all(abs(s[i] - x) < 1e-12 for _, i, x in rows)
        s[q] = -9
        want = sorted(range(600), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len(set(want) & {r[1] for r in rows})
        total += 5
    assert hits / total >= 0.9
    assert [r[1] for r in sorted(got[0])][:4] == [500, 501, 502, 503] and [r[1] for r in sorted(got[500])][:2] == [0, 501]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert len(ann.nearest(df.filter("vec_id in (1, 50, 99)"), F.col("vec_id") % 50 == 0).collect()) == 2


def test_adaptive_scan_keeps_the_nearest():
    rng = np.random.default_rng(1)
    x = ann._unit(rng.standard_normal((3000, 64))).astype(np.float32)
    q = x[:40]
    places = ann.adaptive_scan(x, q, 6)
    true = np.argsort(-(q @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(p) & set(t)) / 6 for p, t in zip(places, true, strict=True)]) > 0.98


def speech(rnd, lang, n):
    parts = {"en": ["the", "ing", "tion", "and", "er"], "de": ["der", "sch", "ung", "ich", "ei"], "fr": ["eau", "ment", "é", "que", "oi"]}[lang]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_language_id(spark):
    rnd = random.Random(8)
    langs = [rnd.choice(["en", "de", "fr"]) for _ in range(240)]
    texts = [speech(rnd, lang, rnd.randrange(5, 80)) for lang in langs]
    texts += [None, "", "123 !!", "the " * 40_000, "쇼핑 목록 그리고 다른 것들"]
    langs += [None, "en", None, "en", None]
    docs = frame(spark, texts, langs)
    model = langid.fit(docs, ~langid.held_out(), per_language=40)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    right = [got[k]["lang_pred"] == langs[k] for k in range(240) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean(right) > 0.95
    assert [got[k]["lang_pred"] for k in (240, 241, 242)] == ["und"] * 3 and got[243]["lang_pred"] == "en"
    assert got[244]["rejected"] and all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["rejected"] for r in got.values())
    none = langid.fit(docs.limit(0), ~langid.held_out())
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_every_language_is_learned(spark):
    rnd = random.Random(3)
    own = [[f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("qu", "zor", "min")] for k in range(70)]
    texts = [" ".join(rnd.choice(own[k % 70]) for _ in range(30)) for k in range(700)]
    langs = [f"l{k % 70:02d}" for k in range(700)]
    docs = frame(spark, texts, langs)
    model = langid.fit(docs, ~langid.held_out())
    assert len(model.languages) == 70
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert np.mean([got[k] == langs[k] for k in range(700) if zlib.crc32(str(k).encode()) % 3 == 1]) > 0.95


def plain_grams(text):
    """Hashed n-gram counts, one by one."""
    x = b" " + langid._letters(text) + b" "
    out = collections.Counter()
    for k in range(len(x)) if len(x) > 2 else ():
        m = 0xFFFFFFFF
        hashes = [x[k] * 3266489917]
        if k + 1 < len(x):
            hashes.append((x[k] * 257 + x[k + 1]) * 2246822519)
        if k + 2 < len(x):
            hashes.append((x[k] * 257 + x[k + 1]) * 65599 + x[k + 2] * 2654435761)
        for h in hashes:
            out[((h & m) ^ (h & m) >> 15) % langid.DIMS] += 1
    return out


def test_language_query_equals_plain_cosines(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [(r["doc_id"], r["lang"]) for r in docs.collect()]
    model = langid.fit(docs, ~langid.held_out())
    learn = [plain_grams(texts[d]) for d, lang in rows if lang is not None and texts[d] is not None and zlib.crc32(str(d).encode()) % 3 != 1]
    df = collections.Counter(p for g in learn for p in g)
    idf = {p: math.log((1 + sum(map(bool, learn))) / (1 + df[p])) + 1 for p in range(langid.DIMS)}
    assert np.allclose(model.idf, [idf[p] for p in range(langid.DIMS)])
    for r in queries.op4_nearest_centroid(spark, sf).collect():
        t = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not t or not any(c.isalpha() for c in t):
            assert r["lang_pred"] == "und"
            continue
        v = {p: math.log1p(c) * idf[p] for p, c in plain_grams(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * c[p] for p, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cos)), key=lambda k: cos[k])
        assert abs(r["score"] - cos[best]) < 1e-4
        assert r["lang_pred"] == model.languages[model.owner[best]]


def test_toxicity_query_equals_plain_sums(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    chain = toxicity.fit(docs, labels, queries.TOXIC_CHAIN)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op2_classifier_chain(spark, sf).collect():
        found = {zlib.crc32(w.encode()) % toxicity.DIMS for w in toxicity._WORD.findall((texts[r["doc_id"]] or "").lower())}
        p = []
        for link in chain.links:
            z = link.bias + sum(w for at, w in zip(link.place.tolist(), link.weight, strict=True) if at in found) + sum(a * b for a, b in zip(link.earlier, p, strict=True))
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))) if found else 0.0)
        assert math.isclose(r["p_low_quality"], p[0], rel_tol=1e-6, abs_tol=1e-9) and math.isclose(r["score"], p[1], rel_tol=1e-6, abs_tol=1e-9)
        assert r["toxic"] == (p[1] >= toxicity.THRESHOLD)


def test_toxicity_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    chain = toxicity.fit(docs, labels.filter(~out), queries.TOXIC_CHAIN)
    x = toxicity.predict(docs, chain).join(labels.filter(out), "doc_id")
    r = x.agg(*(F.count_if(F.expr(c)) for c in ("rejected AND toxic = 1", "rejected AND toxic = 0", "NOT rejected AND toxic = 1"))).first()
    print("precision", r[0] / (r[0] + r[1]), "recall", r[0] / (r[0] + r[2]))
    assert r[0] / (r[0] + r[1]) > 0.85 and r[0] / (r[0] + r[2]) > 0.85


def test_conflicting_labels_are_toxic(spark):
    docs = frame(spark, [f"{'nasty' if k % 2 else 'calm'} word {k % 7}" for k in range(80)])
    lab = [(k, 0, int(k % 2), "x") for k in range(80)]
    twice = spark.createDataFrame([*lab, *((k, 0, 0, "y") for k in range(80))], "doc_id long, low int, tox int, text string")
    a, b = (toxicity.fit(docs, x, ("low", "tox")).links[1] for x in (twice, spark.createDataFrame(lab, "doc_id long, low int, tox int, text string")))
    assert np.array_equal(a.weight, b.weight)


def test_toxicity_chain(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        t, low, tox = words(rnd, 60).split(), k % 5 == 0, k % 4 == 0
        if low:
            t += ["junk$$$"] * 2
        if tox:
            t[rnd.randrange(60)] = rnd.choice(["nasty", "vile"])
        rows.append(" ".join(t))
        if k < 300:
            labels.append((k, int(low), int(tox), "x"))
    rows += [None, "", "!!!", "calm " * 30_000]
    lab = spark.createDataFrame([*labels, (5, None, 1, "x"), (9999, 1, 1, "x"), labels[0]], "doc_id long, low int, tox int, text string")
    docs = frame(spark, rows)
    chain = toxicity.fit(docs, lab, ("low", "tox"))
    got = {r["doc_id"]: r for r in toxicity.predict(docs, chain).collect()}
    assert len(chain.links[1].earlier) == 1
    assert all(got[k]["rejected"] == (k % 4 == 0) for k in range(300, 400))
    assert not any(got[k]["rejected"] for k in range(400, 404))
    kept = toxicity.keep_clean(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not r["rejected"] for r in got.values())
    none = toxicity.fit(docs, lab.limit(0), ("low", "tox"))
    assert not any(r["rejected"] for r in toxicity.predict(docs, none).collect())
    assert toxicity.predict(docs.limit(0), chain).count() == 0


def test_out_of_fold_probabilities_are_less_certain():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 3000, 40)).astype(np.uint32) for _ in range(120)]
    noise = (rng.random(120) < 0.5).astype(float)
    chain = toxicity.fit_chain(rows, {"a": noise, "b": noise})
    own = toxicity._sigmoid(chain.links[0].margin(rows, np.zeros((120, 0))))
    assert np.mean((own > 0.5) == noise) > 0.8  # fits its own rows
    assert abs(chain.links[1].earlier[0]) < 5  # but the chain has seen how little that is worth


def test_near_first_keeps_the_smallest(spark):
    near = F.crc32(F.col("id").cast("string").cast("binary"))
    rows = spark.range(20_000).select("id", F.when(F.col("id") < 50, "rare").otherwise("hot").alias("kind"), near.alias("near"))
    kept = near_first(rows, F.col("near"), "kind", {"rare": 50, "hot": 19_950}, 200).toPandas()
    every = rows.toPandas()
    for kind, n in (("rare", 50), ("hot", 200)):
        want = every[every.kind == kind].nsmallest(n, "near")
        assert set(want.id) <= set(kept[kept.kind == kind].id)
    assert 200 <= (kept.kind == "hot").sum() < 600
    assert not len(near_first(rows, F.col("near"), "kind", {}, 200).toPandas())
