"""Line dedup held against a brute force that knows every repeated run of 50 words."""

import random

import pytest

from taperflow.llm import linededup


def brute(texts, least=50):
    """doc: places of the lines in a run of lines of 50 words or more that has an earlier place."""
    docs = [(t or "").split("\n") for t in texts]
    out = {k: set() for k in range(len(texts))}
    for k, a in enumerate(docs):
        for j in range(k + 1):
            for shift in range(-len(docs[j]) + 1, len(a)):
                if j == k and shift <= 0:
                    continue
                run = []
                for i in range(max(0, shift), min(len(a), len(docs[j]) + shift) + 1):
                    if i < min(len(a), len(docs[j]) + shift) and a[i] == docs[j][i - shift]:
                        run.append(i)
                        continue
                    if sum(a[x].count(" ") + 1 for x in run) >= least:
                        out[k] |= set(run)
                    run = []
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ends_of_runs(spark, seed):
    rnd = random.Random(seed)
    line = lambda n: " ".join(f"v{rnd.randrange(5000)}" for _ in range(n))
    texts, ends = [], []
    for _ in range(40):  # A has a part of the run, B the whole run, C repeats it
        head, run, tail = ([line(rnd.randrange(4, 12)) for _ in range(n)] for n in (1, 9, 1))
        texts.append("\n".join([line(9), *run, line(9)]))
        texts.append("\n".join([line(8), *head, *run, *tail, line(7)]))
        texts.append("\n".join([line(6), *head, *run, *tail, line(5)]))
        ends.append(len(texts) - 1)
    texts += ["\n".join([line(20)] * 6), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    want = brute(texts)
    for k in ends:
        assert len(want[k]) == 11 and got[k]["text"].count("\n") == 1
    for k, t in enumerate(texts):
        kept = (got[k]["text"] or "").split("\n")
        assert not {(t or "").split("\n")[i] for i in want[k]} & set(kept) or k == len(texts) - 3
        assert got[k]["lines_removed"] >= len(want[k])
    # a line's first place always stays
    first = {}
    for k, t in enumerate(texts):
        for x in (t or "").split("\n"):
            first.setdefault(x, k)
    assert all(x in (got[k]["text"] or "").split("\n") for x, k in first.items())
