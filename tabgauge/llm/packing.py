"""Packing of documents into token windows by lexical retrieval.

1. Every text is encoded once; its ids and a MinHash signature of its words are written.
2. One pass counts, over all documents, in how many each hashed word occurs. The counts
   have a fixed number of buckets, whatever the corpus.
3. Documents are dealt by ranges of their signature, so that texts with common words lie
   together and a large group of like texts spans as many ranges as it needs. Each task
   cuts its sorted range into shards of bounded size, builds a BM25 inverted index of a
   shard, and fills windows: a seed document asks with its heaviest words, the unused
   neighbours follow by score as long as they fit, and the best one that does not fit is
   cut to close the window. What is left of it seeds the next window. A document longer than a
   window fills windows of its own first. Without neighbours the next unused document follows.
4. What a shard leaves in the end is cut into sequences whose lengths are powers of two,
   so that no sequence needs padding.

Shards index all documents, copies included, and every id lies in exactly one piece. Work
per seed is bounded by the words it asks with and the documents of a shard.

Defined results: a null text is empty and has the end id alone; null and repeated document
ids are kept, each row being a document of its own; other columns are not read; an empty
table gives no rows. Rows with equal signatures are ordered by their place in what step 1 wrote.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import shared, words
from .token_output import VOCABULARY, text_ids, vocabulary_path

WINDOW = 4096
END_ID = 2
#: Tokens and documents of a shard at most (one document at least), and tokens that a task should get.
SHARD_TOKENS, SHARD_DOCS, TASK_TOKENS = 6 << 20, 1 << 14, 4 << 20
#: Words that a seed asks with, heaviest first.
QUERY_WORDS = 32
#: Neighbours ranked at once.
RANKED = 128
#: Usual constants of BM25.
K1, B = 1.2, 0.75
#: Buckets of hashed words in the counts over all documents, as a power of two.
BUCKET_BITS = 18


@dataclass
class Tokens:
    """Ids of documents in a row; ``bounds[i]:bounds[i + 1]`` are those of document ``i``, the end id last."""

    ids: np.ndarray
    bounds: np.ndarray

    def words(self, word_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of each word, and where each document's words begin. ``word_ends`` marks ids that end one."""
        last = word_ends[self.ids]
        last[self.bounds[1:] - 1] = False  # the end id is no word
        ends = np.flatnonzero(last)
        starts = np.empty_like(ends)
        starts[1:] = ends[:-1] + 1
        bounds = np.searchsorted(ends, self.bounds)
        some = bounds[:-1] < bounds[1:]
        starts[bounds[:-1][some]] = self.bounds[:-1][some]
        # Each id counts with its distance from the word's end, as words with the same ids in another order differ;
        # ids outside of words get some distance too, which no difference of sums below holds.
        place = np.r_[ends, 0][np.cumsum(last) - last] - np.arange(len(self.ids))
        values = words.mix(self.ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)) + np.uint64(1))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        return words.mix(sums[ends + 1] - sums[starts]), bounds


def _signatures(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two MinHash values per document, 0 without words; spread, as those of long texts are small and would lie together."""
    out, some = [], np.flatnonzero(bounds[:-1] < bounds[1:])
    for seed in words.seeded(2, 17):
        values = np.zeros(len(bounds) - 1, np.uint64)
        if len(some):
            values[some] = words.mix(~np.minimum.reduceat(words.mix(hashes ^ seed), bounds[some]))
        out.append(values.view(np.int64))
    return out


def _word_ends(path: str, end_id: int) -> np.ndarray:
    """Marks of the ids that end a word; every id where the vocabulary has none."""
    encoder = text_ids(path).encoder
    marks = np.zeros(max(encoder.tokenizer.get_vocab_size(), end_id + 1), bool)
    marks[list(encoder.ends)] = True
    return marks if encoder.ends else ~marks


def _encoded(path: str, end_id: int, wide: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, word_ends = text_ids(path), _word_ends(path, end_id)
        for batch in batches:
            texts = words.texts_of(batch.column("text"))
            for lo, hi in words.slices(texts):
                ids, bounds = ids_of(texts.slice(lo, hi - lo))
                tokens = Tokens(np.insert(ids.astype(np.uint32), bounds[1:], end_id), bounds + np.arange(len(bounds)))
                first, second = _signatures(*tokens.words(word_ends))
                stored = tokens.ids.astype("<u4" if wide else "<u2")
                cells = pa.Array.from_buffers(
                    pa.binary(), hi - lo, [None, pa.py_buffer((tokens.bounds * stored.itemsize).astype(np.int32)), pa.py_buffer(stored)]
                )
                kept = [batch.column("doc").slice(lo, hi - lo), pa.array(np.diff(tokens.bounds))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(first), pa.array(second), cells], names=["doc", "tokens", "first", "second", "ids"])

    return work


def _tokens_of(cells: pa.Array, wide: bool) -> Tokens:
    size = 4 if wide else 2
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    raw = np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return Tokens(raw.view("<u4" if wide else "<u2"), (offsets - offsets[0]) // size)


def _some_words(cells: pa.Array, wide: bool, word_ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of some documents after others, since what leads to them takes many times the memory of the ids."""
    for lo in range(0, len(cells), 512):
        yield _tokens_of(cells.slice(lo, 512), wide).words(word_ends)


def _all_words(cells: pa.Array, wide: bool, word_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents in a row, and where each document's words begin."""
    hashes, bounds = zip(*_some_words(cells, wide, word_ends), strict=True)
    return np.concatenate(hashes), np.r_[0, np.cumsum(np.concatenate([np.diff(b) for b in bounds]))]


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; ``np.unique`` hashes them first, which takes some ten times as long here."""
    found = np.sort(values)
    return found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


def _counts(path: str, end_id: int, wide: bool):
    """Documents per bucket of words in the task, and at -1 and -2 the documents and words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ends = _word_ends(path, end_id)
        found, rows, total = np.zeros(1 << BUCKET_BITS, np.int64), 0, 0
        for batch in batches:
            for hashes, bounds in _some_words(batch.column("ids"), wide, word_ends):
                each = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                distinct = _distinct((each << BUCKET_BITS) | _buckets(hashes))
                found += np.bincount(distinct & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
                rows, total = rows + len(bounds) - 1, total + len(hashes)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[found[at], rows, total])], names=["bucket", "n"])

    return work


@dataclass
class Corpus:
    """Weight of each bucket of words, from all documents, and words per document."""

    weights: np.ndarray
    words_per_doc: float


def _corpus(counts: DataFrame) -> Corpus:
    """At most ``2 ** BUCKET_BITS + 2`` rows come to the driver."""
    table = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = (table.column(c).to_numpy() for c in ("bucket", "n"))
    total = dict(zip(bucket[bucket < 0].tolist(), n[bucket < 0].tolist(), strict=True))
    docs = total.get(-1, 0)
    found = np.zeros(1 << BUCKET_BITS)
    found[bucket[bucket >= 0]] = n[bucket >= 0]
    return Corpus(np.log1p((docs - found + 0.5) / (found + 0.5)).astype(np.float32), max(total.get(-2, 0) / max(docs, 1), 1.0))


class Index:
    """BM25 inverted index of a shard. Words of one document only lead nowhere and have no postings."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, corpus: Corpus) -> None:
        self.docs = n = len(bounds) - 1
        lengths = np.diff(bounds)
        names, _, codes = words.distinct(hashes)
        pairs, tf = np.unique(codes * n + np.repeat(np.arange(n), lengths), return_counts=True)
        word, doc = pairs // max(n, 1), pairs % max(n, 1)
        spread = np.bincount(word, minlength=len(names))
        shared_ = spread[word] > 1
        word, doc, tf = word[shared_], doc[shared_], tf[shared_]
        self.first = np.r_[0, np.cumsum(np.where(spread > 1, spread, 0))]
        weight = corpus.weights[_buckets(names)]
        norm = K1 * (1 - B + B * lengths / corpus.words_per_doc)
        self.doc = doc
        self.score = weight[word] * tf * (K1 + 1) / (tf + norm[doc])
        # Two bytes are sorted by digits.
        order = np.argsort(doc.astype(np.uint16) if n <= 1 << 16 else doc, kind="stable")
        self.asked, self.weight = word[order], weight[word[order]]
        self.asked_first = np.searchsorted(doc[order], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the heaviest words of ``seed``."""
        lo, hi = self.asked_first[seed], self.asked_first[seed + 1]
        asked = self.asked[lo:hi]
        if len(asked) > QUERY_WORDS:
            asked = asked[np.argpartition(-self.weight[lo:hi], QUERY_WORDS)[:QUERY_WORDS]]
        starts = self.first[asked]
        lengths = self.first[asked + 1] - starts
        at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return np.bincount(self.doc[at], weights=self.score[at], minlength=self.docs)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents with a score, best first; ties in the shard's order."""
        scores = self.scores(seed)
        found = np.flatnonzero((scores > 0) & unused)
        if len(found) > RANKED:
            cut = np.partition(scores[found], len(found) - RANKED)[len(found) - RANKED]
            top = found[scores[found] >= cut]
            yield from top[np.argsort(-scores[top], kind="stable")].tolist()
            found = found[scores[found] < cut]
        yield from found[np.argsort(-scores[found], kind="stable")].tolist()


def fill(sizes: list[int], index: Index, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)``: full windows, then powers of two."""
    unused, out, now = np.ones(len(sizes), bool), [], []
    room, seed, done, following = window, -1, 0, 0

    def put(doc: int, start: int) -> int:
        """Put what fits of ``doc`` from ``start``; where it stopped."""
        nonlocal room, now
        length = min(sizes[doc] - start, room)
        unused[doc] = False
        now.append((doc, start, length))
        room -= length
        if not room:
            out.append(now)
            now, room = [], window
        return start + length

    while True:
        if seed < 0:  # a new seed: the next unused document
            while following < len(sizes) and not unused[following]:
                following += 1
            if following == len(sizes):
                break
            seed, done = following, 0
        done = put(seed, done)
        if done < sizes[seed]:
            continue
        asked, seed = seed, -1
        if room == window:
            continue
        best = -1
        for tried, doc in enumerate(index.neighbours(asked, unused)):
            if sizes[doc] <= room:
                put(doc, 0)
                if room == window:  # it closed the window
                    best = -1
                    break
            elif best < 0:
                best = doc
            if best >= 0 and tried >= RANKED:
                break
        if best >= 0:
            seed, done = best, 0
    return out + powers(now)


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are powers of two, longest first."""
    left, out = sum(p[2] for p in pieces), []
    pieces = pieces[::-1]
    while left:
        room, now = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            doc, start, length = pieces.pop()
            if length > room:
                pieces.append((doc, start + room, length - room))
                length = room
            now.append((doc, start, length))
            room -= length
        out.append(now)
    return out


_PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packed(path: str, end_id: int, kind: pa.DataType, corpus: Corpus, window: int, wide: bool, with_ids: bool):
    names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def shard(docs: list[pa.Array], cells: list[pa.Array], word_ends: np.ndarray, number: int) -> pa.RecordBatch:
        doc_ids = pa.concat_arrays(docs)
        together = pa.concat_arrays(cells)
        tokens = _tokens_of(together, wide)
        sizes = np.diff(tokens.bounds)
        found = fill(sizes.tolist(), Index(*_all_words(together, wide, word_ends), corpus), window)
        of, start, length = (np.array(x, np.int64) for x in zip(*(p for s in found for p in s), strict=True))
        pieces = np.array([len(s) for s in found])
        sequence = np.repeat(np.arange(number, number + len(found)), pieces)
        before = np.r_[0, np.cumsum(length)[:-1]]
        offset = before - np.repeat(before[np.cumsum(pieces) - pieces], pieces)
        ids, at = tokens.ids.astype("<u4"), tokens.bounds[of] + start
        sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        columns = [doc_ids.cast(kind).take(pa.array(of)), *(pa.array(x, pa.int64()) for x in (start, length, sums, sizes[of], sequence, offset))]
        if with_ids:
            flat = ids[np.repeat(at - before, length) + np.arange(length.sum())].astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(np.r_[before, length.sum()], pa.int32()), pa.array(flat)))
        return pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ends = _word_ends(path, end_id)
        number = TaskContext.get().partitionId() << 32
        docs, cells, tokens, rows = [], [], 0, 0
        for batch in batches:
            ends, lo = np.cumsum(batch.column("tokens").to_numpy()), 0
            while lo < batch.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = min(int(np.searchsorted(ends, before + SHARD_TOKENS - tokens, side="right")), lo + SHARD_DOCS - rows)
                hi = min(max(hi, lo), batch.num_rows)
                if hi == lo and not rows:
                    hi = lo + 1  # one document, however long
                docs.append(batch.column("doc").slice(lo, hi - lo))
                cells.append(batch.column("ids").slice(lo, hi - lo))
                tokens, rows = tokens + (int(ends[hi - 1] - before) if hi > lo else 0), rows + hi - lo
                lo = hi
                if lo < batch.num_rows:  # the shard is full
                    out = shard(docs, cells, word_ends, number)
                    number = out.column("sequence_id")[-1].as_py() + 1
                    docs, cells, tokens, rows = [], [], 0, 0
                    yield out
        if rows:
            yield shard(docs, cells, word_ends, number)

    return work


def pack(
    documents: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    window: int = WINDOW,
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and with ``with_ids`` its ``ids``."""
    read = documents.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = read.schema["doc"].dataType
    name = kind.simpleString()
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) > 1 << 16
    encoded = read.mapInArrow(_encoded(vocabulary, end_id, wide), f"doc {name}, tokens bigint, first bigint, second bigint, ids binary")
    placed = shared.written(encoded.withColumn("place", F.monotonically_increasing_id()), "packing", compression="zstd")
    tokens = placed.agg(F.sum("tokens")).first()[0] or 0
    corpus = _corpus(placed.select("ids").mapInArrow(_counts(vocabulary, end_id, wide), "bucket bigint, n bigint"))
    order = ("first", "second", "place")
    dealt = placed.repartitionByRange(max(1, -(-tokens // TASK_TOKENS)), *order).sortWithinPartitions(*order)
    schema = f"doc {name}, {_PIECE}" + (", ids array<int>" if with_ids else "")
    work = _packed(vocabulary, end_id, to_arrow_type(kind), corpus, window, wide, with_ids)
    return dealt.select("doc", "tokens", "ids").mapInArrow(work, schema).withColumnRenamed("doc", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return pack(shared.table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
