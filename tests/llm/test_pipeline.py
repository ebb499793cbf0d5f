"""The pipeline's stages held against brute force on their own input, and their defined results."""

import collections
import hashlib
import math
import random
import shutil
import zlib

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_file
from test_corpus_operators import plain_grams
from test_line_runs import brute as brute_runs
from test_neardup import brute as brute_groups
from tokenizers import Tokenizer

import corpus_pipeline
from taperflow.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d string, lines_removed string, rejected string, score string, sequence_id string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The documents of sf0.001 with odd rows: nulls, empty and very long texts, ties, repeated rows,
    copies of passages, and extra columns with clashing names."""
    d = tmp_path_factory.mktemp("sf")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "a", "b", "c", "d", "e") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    some = [r for r in rows if r[1] and len(r[1]) > 2000][:6]
    rnd = random.Random(4)
    top = max(r[0] for r in rows) + 1
    texts = [None, "", "   ", "1234 !!", "x", some[0][1], some[0][1] + "\nand a last line", some[1][1].replace("\n", "\n\n"), " ".join(rnd.choice(some[2][1].split()) for _ in range(60_000)), "\n".join([some[3][1].split("\n")[0]] * 400)]
    rows += [(top + k, t, None if k % 2 else "en", None if k % 3 else "s", None if t is None else len(t), None, None, None, None, None) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (rows[1][0], "another text of the same id in plain words of the language", *rows[1][2:]), (None, some[4][1], "en", "s", 5, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    shutil.copy(f"{SF}/labels.parquet", f"{d}/labels.parquet")
    return str(d)


def texts_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    """name: (input, output) of every stage."""
    d, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{d}/{name}")
        got = spark.read.parquet(f"{d}/{name}")
        out[name], docs = (docs, got), got
    return out


def test_columns(staged):
    assert list(staged) == ["language_id", "toxicity", "line_dedup", "near_dedup", "packing"]
    for name in list(staged)[:-1]:
        assert staged[name][1].columns == corpus_pipeline.COLUMNS


def test_language_id_equals_plain_cosines(staged):
    docs, got = staged["language_id"]
    model = langid.fit(docs, ~langid.held_out())
    kept = []
    for doc_id, t in texts_of(docs):
        if t and any(c.isalpha() for c in t):
            v = {p: math.log1p(c) * model.idf[p] for p, c in plain_grams(t).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            cos = [sum(x * c[p] for p, x in v.items()) / norm for c in model.centroids]
            best = int(np.argmax(cos))
            if 1 - cos[best] <= model.reach[model.owner[best]]:
                kept.append((doc_id, t))
    assert texts_of(got) == kept
    assert len(kept) > 0.95 * sum(bool(t and any(c.isalpha() for c in t)) for _, t in texts_of(docs))


def test_toxicity_equals_plain_sums(spark, staged, sf_dir):
    docs, got = staged["toxicity"]
    chain = toxicity.fit(docs, corpus_pipeline.toxicity_labels(spark, sf_dir), queries.TOXIC_CHAIN)
    kept = []
    for doc_id, t in texts_of(docs):
        found = {zlib.crc32(w.encode()) % toxicity.DIMS for w in toxicity._WORD.findall((t or "").lower())}
        p = []
        for link in chain.links:
            z = link.bias + sum(w for at, w in zip(link.place.tolist(), link.weight, strict=True) if at in found) + sum(a * b for a, b in zip(link.earlier, p, strict=True))
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))) if found else 0.0)
        if p[-1] < toxicity.THRESHOLD:
            kept.append((doc_id, t))
    assert texts_of(got) == kept


def test_line_dedup_against_all_runs(staged):
    """Every line of a repeated run of 50 words goes, and no line that isn't in one of 32."""
    place = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    docs, got = ({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in x.collect()} for x in staged["line_dedup"])
    docs = sorted(docs, key=lambda r: (*r[:2], place(r[2])))
    assert staged["line_dedup"][0].count() == staged["line_dedup"][1].count()
    texts, after = [t for *_, t in docs], collections.defaultdict(list)
    must, may = brute_runs(texts, 50), brute_runs(texts, 32)
    for *d, t in got:
        after[tuple(d)].append(t)
    times = collections.Counter(tuple(d) for *d, _ in docs)
    for n, (*d, t) in enumerate(docs):
        if times[tuple(d)] == 1:
            lines, (left,) = t.split("\n"), after[tuple(d)]
            rest = iter(lines)
            assert not left or all(x in rest for x in left.split("\n"))  # in their order
            gone = len(lines) - len(left.split("\n")) if left or not t else len(lines)
            assert len(must[n]) <= gone <= len(may[n])
    assert sum(map(len, must.values())) > 50
    for r in staged["line_dedup"][1].collect():
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_near_dedup_equals_brute_force(staged):
    docs, got = staged["near_dedup"]
    rows = texts_of(docs)
    least = brute_groups([t for _, t in rows])
    members = collections.defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        members[least[k]].append(doc_id)
    want = {min((i for i in ids if i is not None), default=None) for ids in members.values()}
    kept = [r["doc_id"] for r in got.collect()]
    assert set(kept) == want and len(kept) == len(want)


def test_packing_gives_the_librarys_ids(staged):
    docs, got = staged["packing"]
    lib = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = {r["doc_id"]: [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    have, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got.collect():
        have[r["doc_id"]].append((r["start"], list(r["ids"])))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == r["length"]
    assert {d: [i for _, p in sorted(parts) for i in p] for d, parts in have.items()} == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_run_is_the_stages(spark, staged, sf_dir):
    again = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (str(r["doc_id"]), r["start"], r["ids"])
    assert sorted(map(key, again.collect())) == sorted(map(key, staged["packing"][1].collect()))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_defined_results(spark, tmp_path, sf_dir):
    """What the docstrings say of odd rows, stage by stage."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(1, None), (2, ""), (3, "  "), (4, "123"), (5, "plain words here"), (5, "plain words here"), (None, "plain words here"), (6, "one")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, *"abcde") for d, t in odd], SCHEMA)
    run = lambda name: dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert not {r["doc_id"] for r in run("language_id").collect()} & {1, 2, 3, 4}
    assert run("toxicity").count() == len(odd)  # no labels: all stay
    assert {(r["doc_id"], r["text"]) for r in run("line_dedup").collect()} == set(odd)
    assert sorted((r["doc_id"] for r in run("near_dedup").collect()), key=str) == [1, 4, 5, 6]
    assert run("packing").filter("doc_id < 4").select("ids").distinct().collect() == [([2],)]


def test_registered():
    import __spark_entry__ as entry

    q = entry.queries()
    assert "pipeline" in q and all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 11))
    assert set(queries.oracle_sql()) <= set(q)
