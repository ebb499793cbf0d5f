"""The pipeline's near-dedup held against brute force over five-word shingles."""

import random

import pytest

import corpus_pipeline
from taperflow.llm import neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


def words(rnd, n):
    return [f"w{rnd.randrange(400)}" for _ in range(n)]


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    least = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and least[a] != least[b]:
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    return dict(enumerate(least))


def corpus(rnd):
    base = [words(rnd, n) for n in (12, 40, 90, 200, 600)]
    texts = [" ".join(b) for b in base]
    for b in base:  # copies with more and more words changed: on both sides of 0.8
        for changes in range(1, 9):
            c = list(b)
            for at in rnd.sample(range(len(c)), changes):
                c[at] = "new"
            texts.append(" ".join(c))
        texts += [" ".join(b[: -len(b) // 10]), " ".join(b[: -len(b) // 4])]
    hot = words(rnd, 120)  # one large group whose members are often under 0.8 of each other
    for _ in range(60):
        c = list(hot)
        for at in rnd.sample(range(120), 3):
            c[at] = f"x{rnd.randrange(999)}"
        texts.append(" ".join(c))
    return texts + [texts[0].upper(), "", None, "  ", "one", "one two", "ONE two"]


@pytest.mark.parametrize("hot", [1, 8, 64])
def test_groups_equal_brute_force(spark, hot):
    texts = corpus(random.Random(3))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(frame(spark, texts), hot=hot).collect()}
    assert got == brute(texts)
    assert len(set(got.values())) > 15


def test_stage_drops_what_two_bits_leave(spark):
    rnd = random.Random(11)
    texts = [" ".join(words(rnd, 100)) for _ in range(12)]
    texts += [" ".join(["new", *t.split()[1:-1], "last"]) for t in texts]  # Jaccard 94 / 98
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, texts), "").collect()}
    assert kept == set(range(12))


def test_close_links_come_by_anchor_covering(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(words(rnd, 900)) for _ in range(6)]
    texts += [t.rsplit(" ", 1)[0] for t in texts]
    asked, whole = [], neardup.simhash.links
    monkeypatch.setattr(neardup.simhash, "links", lambda fps: asked.append(fps.count()) or whole(fps))
    docs = frame(spark, texts)
    nodes = neardup.prefixes(docs, 5, 0.8).withColumnRenamed("doc_id", "least")
    found = {(r["u"], r["v"]) for r in neardup.covering(docs, nodes, 5, 0.8).collect()}
    bits = {r["least"]: (r["node"], r["fp"]) for r in nodes.collect()}
    near = {(max(a, b), min(a, b)) for k in range(6) for (a, x), (b, y) in [(bits[k], bits[k + 6])] if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2}
    assert found == near and len(near) >= 3
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(range(6))
    assert len(asked) == 2


def test_nothing_and_repeated_rows(spark):
    assert neardup.near_groups(frame(spark, [])).count() == 0
    docs = frame(spark, ["a b c d e", "a b c d e"]).unionByName(frame(spark, ["a b c d e"]))
    assert neardup.keep_first(docs).count() == 1


def test_sets_dont_go_through_the_driver(spark):
    """No join of near-dedup's last query sends a table, however small."""
    rnd = random.Random(3)
    texts = [" ".join(words(rnd, 40)) for _ in range(30)]
    x = neardup.near_groups(frame(spark, texts + texts[:5]))
    assert len({r["component_id"] for r in x.collect()}) == 30
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
