"""Token ids as ORC files, in the order of the document ids.

ORC keeps the ids with integer run-length encoding in stripes, with row indexes and a
Bloom filter on the document id. Files and stripes are read in parallel; a look-up of
some ids skips stripes and row groups by their ranges and Bloom filters.

Texts, not ids, are dealt out by ranges of the document id; each task then encodes its
sorted range and writes it. Where ids start among those of all documents follows from
totals per file part, so that no task sees all documents.

The tokenizers library encodes each distinct piece between white space once per task.
The vocabulary drops white space and none of its patterns crosses any, so the ids of a
text are those of its pieces.

Defined results: a null text is empty and holds the end id alone; null document ids come
first; equal document ids are ordered by a hash of their text; other columns are not written.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, words
from .pieces import PieceIds

VOCABULARY = "word_bpe_49k.json"
#: Id that ends every document.
END_ID = 1
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Letters whose runs stay in one piece with most vocabularies: ASCII's in lower case, and those of Latin-1 but for signs.
_ASCII = string.ascii_lowercase
_LATIN = _ASCII + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))


class Encoder:
    """Ids of pieces in lower case. Runs of plain letters go to the library's model, the rest through the whole library."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        suffix = self.model.end_of_word_suffix
        self.ends: set[int] = {i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)}
        # The steps before the model cost more than it does. Where they turn letter by letter into what the model
        # takes, a table does the same.
        self.plain, self.table = None, {}
        for letters in (_LATIN, _ASCII):
            shown = [self._split(c) for c in letters]
            if all(len(s) == 1 for s in shown) and self._split(letters) == ["".join(s[0] for s in shown)]:
                self.plain = re.compile(f"[{letters}]+").fullmatch
                self.table = {ord(c): s[0] for c, s in zip(letters, shown, strict=True) if s[0] != c}
                break
        if self.tokenizer.post_processor or any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values()):
            self.plain = None

    def _split(self, text: str) -> list[str]:
        """What the model gets of a text."""
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normalizer.normalize_str(text) if normalizer else text
        return [part for part, _ in splitter.pre_tokenize_str(text)] if splitter else [text]

    def _rest(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), 500):
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 500], add_special_tokens=False))

    def __call__(self, pieces: list[bytes]) -> Iterator[list[int]]:
        texts = [p.decode() for p in pieces]
        plain = [bool(self.plain and self.plain(t)) for t in texts]
        of_rest = self._rest([t for t, p in zip(texts, plain, strict=True) if not p])
        for text, p in zip(texts, plain, strict=True):
            if not p:
                yield next(of_rest)
            elif text.isascii():
                yield [t.id for t in self.model.tokenize(text)]
            else:
                yield [t.id for t in self.model.tokenize(text.translate(self.table))]


class TextIds:
    """Ids of whole texts, by pieces wherever no special token can be."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path)
        self.pieces = PieceIds(self.encoder, with_space=False, lower=True)
        self.special = [t.content.encode()[:2] for t in self.encoder.tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        ids, bounds = self.pieces(texts)
        odd = sorted({i for lead in self.special for i in words.texts_with(texts, lead)})
        if odd:  # special tokens are matched before the text becomes lower case
            whole = self.encoder.tokenizer.encode_batch_fast(texts.take(pa.array(odd)).to_pylist(), add_special_tokens=False)
            each = np.split(ids, bounds[1:-1])
            for i, encoding in zip(odd, whole, strict=True):
                each[i] = np.array(encoding.ids, np.uint32)
            ids, bounds = np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]
        return ids, bounds


_encoders: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """One encoder per worker process, which Spark uses for many tasks."""
    if path not in _encoders:
        _encoders[path] = TextIds(path)
    return _encoders[path]


def _encoded(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_ids(path)
        for batch in batches:
            texts = words.texts_of(batch.column("text"))
            for lo, hi in words.slices(texts):
                ids, bounds = ids_of(texts.slice(lo, hi - lo))
                ids = np.insert(ids.astype(np.int32), bounds[1:], end_id)
                lists = pa.ListArray.from_arrays(pa.array(bounds + np.arange(len(bounds)), pa.int32()), pa.array(ids))
                kept = [batch.column(c).slice(lo, hi - lo) for c in ("part", "place", "doc_id")]
                yield pa.RecordBatch.from_arrays([*kept, lists], names=["part", "place", "doc_id", "ids"])

    return encode


def write(
    documents: DataFrame,
    folder: str,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
) -> None:
    """Write ``part, place, doc_id, ids`` to ``folder``; ``part`` and ``place`` give the order of all rows."""
    read = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The ids of the parts follow the ranges, and the rows of a part follow each other.
    # What Spark samples to find the ranges holds a hash of the text, not the text.
    order = ("doc_id", F.xxhash64("text"))
    placed = (
        read.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "doc_id", "text")
    )
    kind = dict(read.dtypes)["doc_id"]
    (
        placed.mapInArrow(_encoded(vocabulary, end_id), f"part int, place bigint, doc_id {kind}, ids array<int>")
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(folder)
    )


def read(spark: SparkSession, folder: str, doc_ids: list | None = None) -> DataFrame:
    """Rows of the files; with ``doc_ids``, only stripes that may hold them are read."""
    found = spark.read.orc(folder)
    return found if doc_ids is None else found.filter(F.col("doc_id").isin(doc_ids))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        bounds = lists.offsets.to_numpy()
        sums = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        kept = [batch.column(c) for c in ("part", "place", "doc_id")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())],
            names=["part", "place", "doc_id", "n_tokens", "ids_crc32"],
        )


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """Per row of the files: ``doc_id``, ``start`` among all ids, ``n_tokens``, ``ids_crc32``."""
    rows = read(spark, folder)
    kind = dict(rows.dtypes)["doc_id"]
    found = shared.written(
        rows.mapInArrow(_summaries, f"part int, place bigint, doc_id {kind}, n_tokens bigint, ids_crc32 bigint"), "ids"
    )
    # One row per part: as many as the write had tasks.
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = found.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return running.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, written and read back."""
    folder = shared.new_folder(spark, "token-ids")
    write(shared.table(spark, sf_dir, "documents"), folder, vocabulary_path(VOCABULARY))
    return positions(spark, folder)
