"""Packing: every id in one piece, against the library's ids; the index against a plain BM25."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tabgauge.llm import packing, token_output, words
from tabgauge.llm.token_output import vocabulary_path

DATA = Path("/root/testdata/sf0.001")
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def whole(rows, documents, window=packing.WINDOW):
    """Every document's pieces are its ids; every sequence is gapless and needs no padding."""
    encode = library()
    wanted = Counter((i, tuple(encode(t))) for i, t in documents)
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == window or at < window and at & (at - 1) == 0
    told = Counter()
    for i, ids in wanted.elements():
        told[i, len(ids)] += 1
    assert {k: sum(r["length"] for r in v) for k, v in by_doc.items()} == {k: k[1] * n for k, n in told.items()}
    for key, pieces in by_doc.items():
        texts = [np.array(ids, "<u4") for i, ids in wanted if (i, len(ids)) == key]
        for r in pieces:
            a, b = r["start"], r["start"] + r["length"]
            assert r["ids_crc32"] in {zlib.crc32(ids[a:b]) for ids in texts}
        starts = Counter(r["start"] for r in pieces)
        assert starts[0] == told[key]
    return by_sequence


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are absent")
def test_query(spark):
    found = packing.query(spark, str(DATA))
    assert found.columns == COLUMNS
    documents = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text")
    whole(found.collect(), [tuple(r) for r in documents.collect()])


def test_odd_rows_and_ids(spark, monkeypatch):
    random.seed(4)
    texts = [None, "", " \n ", "one", "Été ñandú 日本 🎉", "<|endoftext|> end", "a-b.c!" * 4000, "same words here " * 30]
    rows = [(random.choice([None, *range(60)]), random.choice(texts)) for _ in range(300)]
    frame = spark.createDataFrame([(*r, 5, b"x", 7) for r in rows], "doc_id long, text string, tokens long, ids binary, first int")
    path = vocabulary_path(packing.VOCABULARY)
    whole(packing.pack(frame, path).collect(), rows)
    # Shards of a few documents, and a smaller window.
    monkeypatch.setattr(packing, "SHARD_DOCS", 7)
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3000)
    few = packing.pack(frame, path, window=256, with_ids=True).collect()
    whole(few, rows, 256)
    assert all(zlib.crc32(np.array(r["ids"], "<u4")) == r["ids_crc32"] for r in few)
    assert packing.pack(frame.limit(0), path).collect() == []


def test_index_is_bm25(monkeypatch):
    random.seed(6)
    monkeypatch.setattr(packing, "QUERY_WORDS", 5)
    names = words.seeded(60, 9)
    docs = [[random.randrange(60) ** 2 // 60 for _ in range(random.randrange(0, 40))] for _ in range(50)]
    bounds = np.r_[0, np.cumsum([len(d) for d in docs])]
    hashes = np.concatenate([names[d] for d in docs if d])
    df = Counter(w for d in docs for w in set(d))
    mean = sum(map(len, docs)) / len(docs)
    weights = np.zeros(1 << packing.BUCKET_BITS, np.float32)
    weight = {w: np.float32(math.log(1 + (50 - n + 0.5) / (n + 0.5))) for w, n in df.items()}
    for w, v in weight.items():
        weights[packing._buckets(names[w : w + 1])] = v
    index = packing.Index(hashes, bounds, packing.Corpus(weights, mean))
    for seed in range(50):
        shared = sorted((w for w in set(docs[seed]) if df[w] > 1), key=lambda w: -weight[w])
        if len(shared) > 5 and weight[shared[4]] == weight[shared[5]]:
            continue  # either word may be asked for
        for other, score in enumerate(index.scores(seed)):
            tf = Counter(docs[other])
            norm = packing.K1 * (1 - packing.B + packing.B * len(docs[other]) / mean)
            plain = sum(float(weight[w]) * tf[w] * (packing.K1 + 1) / (tf[w] + norm) for w in shared[:5] if tf[w])
            assert math.isclose(score, plain, rel_tol=1e-5, abs_tol=1e-9)


def test_neighbours_share_a_window(spark):
    random.seed(8)
    subjects = [[f"{a}{b}{c}" for b in "aeiou" for c in "klmnprst"] for a in ("br", "cl", "fr", "gl")]
    rows = [(i, " ".join(random.choices(subjects[i % 4], k=60))) for i in range(400)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary_path(packing.VOCABULARY), window=1024).collect()
    pairs = Counter()
    for pieces in whole(found, rows, 1024).values():
        kinds = Counter(r["doc_id"] % 4 for r in pieces)
        pairs["same"] += sum(n * (n - 1) for n in kinds.values())
        pairs["all"] += len(pieces) * (len(pieces) - 1)
    assert pairs["same"] > 0.9 * pairs["all"]


def test_powers():
    assert [sum(p[2] for p in s) for s in packing.powers([(0, 5, 7), (1, 0, 6)])] == [8, 4, 1]
    assert packing.powers([]) == []


def test_distinct_buckets_are_sorted_and_not_hashed(monkeypatch):
    monkeypatch.setattr(packing.np, "unique", None)
    values = np.array([5, 3, 5, 1 << 40, 0, 3])
    assert packing._distinct(values).tolist() == [0, 3, 5, 1 << 40]
    assert packing._distinct(values[:0]).tolist() == []


def test_words_hash_alike_wherever_they_stand():
    ends = np.zeros(100, bool)
    ends[50:] = True  # ids from 50 on end a word
    one = packing.Tokens(np.array([7, 8, 60, 55, 2], np.uint32), np.array([0, 5]))
    two = packing.Tokens(np.array([9, 2, 55, 7, 8, 60, 3, 2, 8, 7, 60, 2], np.uint32), np.array([0, 2, 8, 12]))
    a, a_bounds = one.words(ends)
    b, b_bounds = two.words(ends)
    assert (a_bounds.tolist(), b_bounds.tolist()) == ([0, 2], [0, 0, 2, 3])
    assert b[:2].tolist() == a[::-1].tolist() and b[2] != a[0]


def test_distinct_values_as_numpy_gives_them():
    random.seed(9)
    for values in ([], [7], [random.randrange(40) for _ in range(500)], [1 << 63, 3, 1 << 63, 0]):
        values = np.array(values, np.uint64)
        for ours, numpys in zip(words.distinct(values), np.unique(values, return_index=True, return_inverse=True), strict=True):
            assert ours.tolist() == numpys.tolist()


def test_plain_words_go_to_the_model_alone(monkeypatch):
    random.seed(10)
    encode = library()
    plain = ["a", "the", "ll", "s", "x" * 300] + ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randrange(1, 14))) for _ in range(2000)]
    plain += ["".join(random.choices("abcoéèñüßøÉÑÜþÿ", k=random.randrange(1, 12))) for _ in range(1000)]
    odd = ["été", "e\u0301t", "a×b", "µª", "a1", "'s", "日本", "ﬁn", "x,"]
    encoder = token_output.Encoder(vocabulary_path(packing.VOCABULARY))
    mixed = [w for pair in zip(plain, odd * 300) for w in pair]
    assert list(encoder([w.encode() for w in mixed])) == [encode(w)[:-1] for w in mixed]
    monkeypatch.setattr(encoder, "tokenizer", None)
    assert list(encoder([w.encode() for w in plain])) == [encode(w)[:-1] for w in plain]


def test_words_of_a_shard_come_from_some_documents_at_a_time(monkeypatch):
    random.seed(12)
    ends = np.zeros(300, bool)
    ends[100:] = True
    docs = [np.array([*random.choices(range(3, 300), k=random.randrange(9)), 2], "<u2").tobytes() for _ in range(1300)]
    cells = pa.array(docs, pa.binary())
    whole_, bounds = packing._tokens_of(cells, False).words(ends)
    right, most = packing._tokens_of, []
    monkeypatch.setattr(packing, "_tokens_of", lambda some, wide: most.append(len(some)) or right(some, wide))
    hashes, starts = packing._all_words(cells, False, ends)
    assert hashes.tolist() == whole_.tolist() and starts.tolist() == bounds.tolist()
    assert max(most) == 512
