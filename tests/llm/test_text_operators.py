"""Packing, BPE and transport streams against the libraries and by round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taperflow.llm import bpe, media_ts, packing, queries

SCHEMA = "doc_id long, text string, _k int, length int, media string"
ODD = ["", "  a  b\n\n c ", "x<|endoftext|> y", " <|endoftext|><|endoftext|>", "\x1c\x1da \x85b　 c\xa0 d", "ΑΣ ΣΑΣ Ές", "it's I'LL we've 123 4५६ ²³ ﬁ Å é", "日本語テキスト 🙂🙂", "aaaaaaaa aaaa", "\r\n\r\n a\t\tb   ", "﻿x", "Ɛɛ İ ı ß ẞ", "\x01 a\x01b"]


def rows():
    rnd = random.Random(3)
    words = ["alpha", "Beta,", "gamma.", "été", "x"]
    texts = [*ODD, None, "word " * 30_000, *(" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 400))) for _ in range(60)), "same text", "same text"]
    return [(k, t, 1, 2, "m") for k, t in enumerate(texts)] + [(5, "repeated id", 1, 2, "m"), (None, "no id", 1, 2, "m")]


@pytest.mark.parametrize(("name", "encode"), [("byte_bpe_50k.json", lambda t, p: bpe.codec(p).encode(t)), ("word_bpe_49k.json", packing.encode_text)])
def test_ids_equal_the_library(name, encode):
    rnd = random.Random(1)
    pool = [*range(32, 127), *range(9, 14), *range(0x80, 0x250), *range(0x370, 0x600), 32, 0xA0, 0x2003]
    texts = ODD + ["".join(chr(rnd.choice(pool)) for _ in range(rnd.randrange(1, 120))) for _ in range(200)]
    lib = Tokenizer.from_file(path(name))
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t, path(name)), "<u4").tolist() == want, repr(t)


def test_bpe_query_columns(spark):
    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = bpe.digest_documents(spark.createDataFrame(rows(), SCHEMA), path("byte_bpe_50k.json")).collect()
    want = sorted((str(r[0]), len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r in rows() for i in [lib.encode(r[1] or "", add_special_tokens=False).ids])
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert bpe.digest_documents(spark.createDataFrame([], SCHEMA), path("byte_bpe_50k.json")).count() == 0
    full = bpe.encode_documents(spark.createDataFrame(rows()[:20], SCHEMA), path("byte_bpe_50k.json")).collect()
    assert {r["decoded"] for r in full} == {r[1] or "" for r in rows()[:20]}


def test_packing_keeps_extra_columns(spark):
    names = ["_k", "_i", "_pid", "_mid", "_kind", "_n", "_before", "_base", "_full", "_tail", "k", "i", "mid", "pid", "base", "before"]
    rnd = random.Random(2)
    rows = [(rnd.randrange(1, 4097), *(f"{c}{k}" for c in names)) for k in range(500)]
    df = spark.createDataFrame(rows, ", ".join(["length int", *(f"{c} string" for c in names)]))
    got = packing.harmonic_pack(df.withColumn("offset", F.lit("old"))).collect()
    assert sorted(tuple(r[c] for c in ["length", *names]) for r in got) == sorted(rows)
    with pytest.raises(Exception, match="length must be"):
        packing.harmonic_pack(spark.createDataFrame([(5000,)], "length int")).collect()


def test_media_query_keeps_units(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op8_transport_streams(spark, sf).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        p = media_ts.padded(texts[r["doc_id"]])
        media = media_ts.mux(p)
        assert (r["payload_bytes"], r["payload_sha256"], r["media_bytes"], r["media_sha256"]) == (len(p), hashlib.sha256(p).hexdigest(), len(media), hashlib.sha256(media).hexdigest())
        assert [u["at"] for u in r["units"]] == [*range(0, len(p), 16384)]
        assert [(u["pts"], u["random_access"]) for u in r["units"]] == [(3600 * k, k % 8 == 0) for k in range(len(r["units"]))]


def test_registered_queries_equal_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    byte, word = (Tokenizer.from_file(path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for r in queries.op9_pair_index_bpe(spark, sf).collect():
        ids = byte.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    ids = {d: [*word.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    for r in queries.op1_harmonic_packing(spark, sf).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_cuts_are_near_reciprocals():
    for n in [*range(1, 300), 4095, 4096, 4097, 50_000]:
        cuts = packing.reciprocal_cuts(n)
        assert sum(cuts) == n and all(c * (4096 // c) >= 4096 * (1 - packing.SLACK) or c * (4096 // c) > 4096 - 4096 // c for c in cuts)


def test_packing_is_whole(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = packing.pack_documents(docs, path("word_bpe_49k.json")).collect()
    lib = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = sorted((str(r[0]), tuple([*lib.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows())
    by_doc, by_seq = {}, {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        by_doc.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], r["ids"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    singles = [w for w in want if sum(x[0] == w[0] for x in want) == 1]
    for doc, ids in singles:
        assert [i for _, p in sorted(by_doc[doc, len(ids)]) for i in p] == list(ids)
    assert sum(r["length"] for r in got) == sum(len(i) for _, i in want)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(by_seq) == list(range(len(by_seq)))
    total = sum(r["length"] for r in got)
    assert len(by_seq) * 4096 <= total * 1.02 + 2 * 4096
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("size", [64, 128, 192, 16384 - 64, 16384, 16384 + 64, 300_032])
def test_transport_stream_round_trip(size):
    data = random.Random(size).randbytes(size)
    media = media_ts.mux(data)
    got = media_ts.demux(media)
    assert got["payload"] == data and len(media) % 188 == 0
    assert not any(v for k, v in got.items() if k.endswith("errors"))
    assert [u[0] for u in got["units"]] == [3600 * k for k in range(len(got["units"]))]
    assert [u[1] for u in got["units"]] == [k % 8 == 0 for k in range(len(got["units"]))]


def test_transport_stream_faults_are_counted():
    media = bytearray(media_ts.mux(bytes(20_000)))
    lost = bytes(media[: 188 * 10] + media[188 * 11 :])
    assert media_ts.demux(lost)["continuity_errors"] == 1
    media[188 * 5] = 0
    assert media_ts.demux(bytes(media))["sync_errors"] == 1
    media = bytearray(media_ts.mux(bytes(64)))
    media[20] ^= 1
    assert media_ts.demux(bytes(media))["table_errors"] == 1
    assert media_ts.demux(b"")["payload"] == b"" and media_ts.demux(b"\x47" * 188)["payload"] == b""


def test_media_query(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = media_ts.read_media(media_ts.mux_documents(docs)).collect()
    assert len(got) == len(rows())
    want = {str(r[0]): (r[1] or "").encode() for r in rows() if r[0] != 5}
    seen = {}
    for r in got:
        if r["doc_id"] != 5:
            raw = want[str(r["doc_id"])]
            assert bytes(r["payload"]) == media_ts.padded(raw) and r["n_bytes"] == len(raw)
            assert r["payload_sha256"] == hashlib.sha256(media_ts.padded(raw)).hexdigest() and r["tail_crc32"] == zlib.crc32(media_ts.padded(raw)[-64:])
        seen.setdefault(bytes(r["payload"]), set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in seen.values())
