"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

**Lookahead.** Whether a token is final depends on the bytes to its right only through
merges of higher priority that could take its last part away. ``sufficient_lookahead``
bounds how far that reaches, from the merge list alone. With ``F[t]`` the bytes that must
be seen right of ``t`` to know that ``t`` is formed, a merge ``(a, b) -> t`` has

    F[t] = max(F[b], F[a] - |b|, max(|v| + F[v] for earlier merges (b, v)))

and ``t`` is final once ``max(|v| + F[v])`` over all merges ``(t, v)`` is seen too.

**Encoding.** ``Transducer`` takes bytes as they come and gives out tokens as soon as that
many bytes follow them; it keeps the lookahead and one step of bytes, however long the
input is. Tokens cut at a final boundary encode independently on both sides.

**Decoding.** ``TextDecoder`` turns ids into bytes chunk by chunk and runs them through an
incremental UTF-8 decoder, which keeps at most the bytes of one unfinished character.

Texts go through in pieces (``pieces.PieceIds``): a cut before white space that follows
something else, or between a letter and a mark, is a token boundary under the pattern.
Texts with white space beyond ASCII or with a special token run through it as a whole.

Defined results: a null text is an empty one and has no tokens; rows are kept one by one,
repeated or not, with the columns in ``keep``.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words
from .pieces import PieceIds
from .token_output import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"

# Fixed value: the pattern that cuts a text before byte-level merges.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: Bytes that a transducer takes in beyond its lookahead before it looks for final tokens.
STEP_BYTES = 2048
#: Ids that a decoder turns into text at once.
DECODE_IDS = 1 << 16
#: Words that a task remembers before it starts anew.
REMEMBERED = 300_000


def byte_characters() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, bytes and merges from a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        to_byte = byte_characters()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(map(to_byte.__getitem__, t)) for t, i in ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = [0] * 256
        for character, byte in to_byte.items():
            self.byte_ids[byte] = ids[character]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.lookahead = sufficient_lookahead(self.merges, {i: len(b) for i, b in self.bytes_of.items()})


def sufficient_lookahead(merges: dict[tuple[int, int], tuple[int, int]], size: dict[int, int]) -> int:
    """Bytes after a token's end that decide whether it is final, for any text."""
    formed: dict[int, int] = {}
    taken: dict[int, int] = {}
    most = 0
    for (a, b), (_, t) in sorted(merges.items(), key=lambda x: x[1][0]):
        need = max(formed.get(b, 0), formed.get(a, 0) - size[b], taken.get(b, 0))
        formed[t] = max(formed.get(t, 0), need)
        # The token after may itself be taken by an earlier merge with what follows it.
        taken[a] = max(taken.get(a, 0), size[b] + max(formed.get(b, 0), taken.get(b, 0)))
        most = max(most, formed[t], taken[a])
    return most


def merge_all(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges, the earliest in the list first and from the left, until none is left."""
    if len(ids) > 48:
        return _merge_long(ids, merges)
    get = merges.get
    ids = list(ids)
    found = [get(p) for p in zip(ids, ids[1:])]
    while True:
        best = None
        for at, x in enumerate(found):
            if x is not None and (best is None or x < best):
                best, where = x, at
        if best is None:
            return ids
        ids[where : where + 2] = [best[1]]
        del found[where]
        if where < len(found):
            found[where] = get((ids[where], ids[where + 1]))
        if where:
            found[where - 1] = get((ids[where - 1], ids[where]))


def _merge_long(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same with a queue of merges and links between neighbours."""
    ids = list(ids)
    n = len(ids)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(x[0], at, ids[at], ids[at + 1], x[1]) for at in range(n - 1) if (x := merges.get((ids[at], ids[at + 1])))]
    heapq.heapify(queue)
    while queue:
        _, at, a, b, new = heapq.heappop(queue)
        after = right[at]
        if ids[at] != a or after < 0 or ids[after] != b:
            continue
        ids[at], ids[after] = new, -1
        right[at] = right[after]
        if right[at] >= 0:
            left[right[at]] = at
        for x, y in ((left[at], at), (at, right[at])):
            if x >= 0 and y >= 0 and (m := merges.get((ids[x], ids[y]))):
                heapq.heappush(queue, (m[0], x, ids[x], ids[y], m[1]))
    return [i for i in ids if i >= 0]


class Transducer:
    """Bytes of one word in, final tokens out."""

    def __init__(self, vocabulary: Vocabulary, step: int = STEP_BYTES) -> None:
        self.vocabulary, self.step = vocabulary, step
        self.buffer = bytearray()

    def _tokens(self) -> list[int]:
        byte_ids = self.vocabulary.byte_ids
        return merge_all([byte_ids[b] for b in self.buffer], self.vocabulary.merges)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        lookahead, bytes_of = self.vocabulary.lookahead, self.vocabulary.bytes_of
        for at in range(0, len(data), self.step):
            self.buffer += data[at : at + self.step]
            if len(self.buffer) < lookahead + self.step:
                continue
            limit, end = len(self.buffer) - lookahead, 0
            for token in self._tokens():
                if end + len(bytes_of[token]) > limit:
                    break
                end += len(bytes_of[token])
                out.append(token)
            del self.buffer[:end]
        return out

    def finish(self) -> list[int]:
        out = self._tokens()
        self.buffer.clear()
        return out


class TextEncoder:
    """Ids of texts and of pieces of texts."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import regex

        self.vocabulary = vocabulary
        self.pattern = regex.compile(PATTERN)
        special = "|".join(regex.escape(t) for t in vocabulary.special)
        self.special = regex.compile(f"({special})") if special else None
        self.known: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            data = word.encode()
            transducer = Transducer(self.vocabulary)
            ids = transducer.feed(data) + transducer.finish()
            if len(data) <= 256:
                self.known[word] = ids
        return ids

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, a few at a time."""
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            if part in self.vocabulary.special:
                yield [self.vocabulary.special[part]]
            elif part:
                for match in self.pattern.finditer(part):
                    yield self._word(match[0])

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        findall, word_ids, out = self.pattern.findall, self._word, []
        for piece in pieces:
            found = [word_ids(word) for word in findall(piece.decode())]
            out.append(found[0] if len(found) == 1 else [i for ids in found for i in ids])
        return out


class TextDecoder:
    """Ids in, text out; keeps the bytes of one unfinished character."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        top = max(vocabulary.bytes_of) + 1
        each = [vocabulary.bytes_of.get(i, b"") for i in range(top)]
        self.size = np.fromiter(map(len, each), np.int64, top)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(each), np.uint8)
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.first[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.utf8.decode(self.flat[at].tobytes())

    def finish(self) -> str:
        out = self.utf8.decode(b"", final=True)
        self.utf8.reset()
        return out

    def chunks(self, ids: np.ndarray, limit: int = DECODE_IDS) -> Iterator[str]:
        for at in range(0, len(ids), limit):
            yield self.feed(ids[at : at + limit])
        yield self.finish()


# White space beyond ASCII, by code point.
_WIDE_SPACE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def has_wide_space(texts: pa.Array) -> list[int]:
    """Texts that hold white space beyond ASCII."""
    return sorted({i for c in _WIDE_SPACE for i in words.texts_with(texts, chr(c).encode())})


class Coder:
    """Encoder and decoder of one task."""

    def __init__(self, path: str) -> None:
        vocabulary = Vocabulary(path)
        self.encoder = TextEncoder(vocabulary)
        self.pieces = PieceIds(self.encoder, with_space=True, lower=False)
        self.decoder = TextDecoder(vocabulary)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        ids, bounds = self.pieces(texts)
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        special = {i for t in self.encoder.vocabulary.special for i in words.texts_with(texts, t.encode())}
        for i in sorted(special.union(has_wide_space(texts))):
            whole = [x for some in self.encoder.stream(texts[i].as_py()) for x in some]
            out[i] = np.array(whole, np.uint32)
        return out


_coders: dict[str, Coder] = {}


def _coder(path: str) -> Coder:
    """One coder per worker process, which Spark uses for many tasks."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def round_trip(documents: DataFrame, vocabulary: str, text_col: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """The columns in ``keep`` with ``ids`` of each text and ``decoded``, the text that they decode to."""
    return _coded(
        documents, vocabulary, text_col, keep, "ids array<int>, decoded string",
        lambda ids, decoded: [
            pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
            pa.array(["".join(d) for d in decoded], pa.string()),
        ],
    )


def digests(documents: DataFrame, vocabulary: str, text_col: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """The columns in ``keep`` with ``n_tokens`` and the SHA-256 of ids and decoded text."""

    def fold(ids, decoded) -> list[pa.Array]:
        of_text = []
        for parts in decoded:
            h = hashlib.sha256()
            for part in parts:
                h.update(part.encode())
            of_text.append(h.hexdigest())
        return [
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i.astype("<u4", copy=False)).hexdigest() for i in ids]),
            pa.array(of_text),
        ]

    return _coded(documents, vocabulary, text_col, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", fold)


def _coded(documents: DataFrame, vocabulary: str, text_col: str, keep, schema: str, fold) -> DataFrame:
    keep = list(documents.columns) if keep is None else list(keep)
    kinds = dict(documents.dtypes)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in batches:
            texts = words.texts_of(batch.column("text_"))
            for lo, hi in words.slices(texts):
                ids = coder.encode(texts.slice(lo, hi - lo))
                made = fold(ids, (coder.decoder.chunks(i) for i in ids))
                yield pa.RecordBatch.from_arrays([batch.column("row_").slice(lo, hi - lo), *made], names=["row_", *names])

    inner = ", ".join(f"c{i}: {kinds[c]}" for i, c in enumerate(keep)) or "none: int"
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(0).alias("none"))
    read = documents.select(row.alias("row_"), F.col(f"`{text_col}`").cast("string").alias("text_"))
    found = read.mapInArrow(run, f"row_ struct<{inner}>, {schema}")
    # Results stand beside kept columns; a kept column of the same name gives way.
    return found.select(*[F.col(f"row_.c{i}").alias(c) for i, c in enumerate(keep) if c not in names], *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded."""
    return digests(shared.table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY), keep=["doc_id"])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: documents with their token ids and digests."""
    return digests(docs, vocabulary_path(VOCABULARY), keep=["doc_id", "lang", "source"])
