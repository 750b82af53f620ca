"""Toxicity: a subsequence string kernel, Nyström landmarks and a linear support vector machine.

**Kernel.** Two words are as alike as the triples of characters that both hold in order, with
up to ``SKIPPED`` others between; each skipped one costs ``DECAY``. So ``i.diot`` and
``idiiot`` stay close to ``idiot``. Words are in lower case, without marks at their ends,
and with signs for begin and end. A word is read at every stretch up to ``STRETCH``: at
stretch ``k``, ``k`` characters between two neighbours are the rule and cost nothing, and each
one more or less, and each letter left out, costs ``DECAY``; no triple counts
for more than in a landmark there. So ``ixxdxxixxoxxt`` is as close to ``idiot`` as itself. Words
with other signs than letters and digits inside (marks, ASCII or not, zero-width characters,
combining accents) count as they are and without them, so ``i-d-i-o-t`` is found too. Runs
of ``RUN`` or more words of one letter each count as one word as well: ``i d i o t``. Of all
readings of a word the closest counts. More than ``STRETCH + 1`` letters or digits at most
gaps are another word.

**Landmarks.** The words that set apart toxic training documents best, no two of them alike.
A word enters through its kernel values with the landmarks, each as a share of the
landmark's own value, as far as the share exceeds ``SHARE``; words that resemble no
landmark enter as zeros. A document is the maximum, and the logarithm of the sum, over its
words; both are turned by the inverse root of the landmarks' own kernel matrix (Nyström).

**Training.** Labels are taken from rows whose CRC-32 of the document id is not 2 modulo 4,
at most ``TRAIN_ROWS`` of them, chosen by hash. Counting words, and the kernel values of the
training documents, are Spark jobs; the driver fits ``2 * LANDMARKS`` weights with squared
hinge loss, and a logistic curve from margins to scores on every fifth row.

Scoring reads texts alone, keeps nothing per document, and remembers distinct words per
process. Defined results: a null text is an empty one and scores as such; without both
labels among the training rows every score is the share of toxic ones (0 if there are
none); rows are kept one by one, repeated or not; of several labels of a document the
largest counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words

#: Most labelled rows that a model is trained on.
TRAIN_ROWS = 12_000
LANDMARKS = 96
#: Words considered as landmarks.
CANDIDATES = 1500
MIN_DOCUMENTS = 4
#: Characters that a triple may skip (or lack, when stretched), and what each costs.
SKIPPED = 2
DECAY = 0.6
#: Most characters between neighbours that a word is read with at no cost.
STRETCH = 3
#: One-letter words in a row that are read as one word, and letters of it at a time.
RUN = 3
RUN_WINDOW = 64
#: Share of a landmark's own kernel value from which on a word counts.
SHARE = 0.4
#: Score from which on a document counts as toxic.
PREDICT = 0.3
#: Codes of triples up to which their rows are read off a table.
TABLE_CODES = 1 << 22
#: Distinct words that a process remembers before it starts anew.
REMEMBERED = 2_000_000

HELD_OUT = 2
_EDGE = np.zeros(256, bool)
_EDGE[:128] = ~words.WORD_CHARS[:128]
_MARKS = bytes(np.flatnonzero(_EDGE).tolist())


def _costs(stretch: int) -> dict[int, int]:
    """By the distance of two characters: letters skipped, ``stretch + 1`` characters each, and characters too many or too few."""
    step = stretch + 1
    return {d: c for d in range(1, (SKIPPED + 2) * step) if (c := min(s + abs(d - (s + 1) * step) for s in range(SKIPPED + 1))) <= SKIPPED}


#: Per stretch: distances of a triple's second and third character from the first, and the weight.
_PLACES = [[(a, a + b, DECAY ** (c + d)) for a, c in _costs(k).items() for b, d in _costs(k).items() if c + d <= SKIPPED] for k in range(STRETCH + 1)]
_BEGIN, _END = 0x110000, 0x110001  # beyond all characters


def trimmed(found: words.Words) -> words.Words:
    """Words without the ASCII marks at their ends; those of marks alone go."""
    starts, ends, data = found.starts.copy(), found.ends.copy(), found.data
    for side, step in ((ends, -1), (starts, 1)):
        live = np.arange(len(starts))
        while len(live):
            at = side[live] - 1 if step < 0 else side[live]
            live = live[(starts[live] < ends[live])]
            at = side[live] - 1 if step < 0 else side[live]
            live = live[_EDGE[data[at]]]
            side[live] += step
    keep = starts < ends
    bounds = np.r_[0, np.cumsum(keep)][found.bounds]
    return words.Words(data, starts[keep], ends[keep], bounds, found.offsets)


@lru_cache(maxsize=1)
def _solid() -> np.ndarray:
    """True for the code points of letters and digits."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def bare(word: bytes) -> bytes:
    """Letters and digits of a word alone."""
    word = word.translate(None, _MARKS)
    return word if word.isascii() else "".join(c for c in word.decode() if c.isalnum()).encode()


def spelled_out(found: words.Words) -> tuple[list[int], list[bytes]]:
    """Runs of one-letter words, joined: the text and the letters of each; long ones in overlapping windows."""
    points = np.frombuffer(found.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.flatnonzero((found.data & 0xC0) != 0x80)
    solid = np.zeros(len(found.data) + 1, np.int64)
    solid[begins + 1] = _solid()[points]
    np.cumsum(solid, out=solid)
    letters = solid[found.ends] - solid[found.starts]
    # Words of marks alone neither count nor end a run.
    short = np.flatnonzero(letters < 2)
    if len(short) < RUN:
        return [], []
    text = np.searchsorted(found.bounds, short, side="right") - 1
    first = np.flatnonzero(np.r_[True, (short[1:] != short[:-1] + 1) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], len(short)]
    texts, runs = [], []
    for a, b in zip(first[last - first >= RUN].tolist(), last[last - first >= RUN].tolist(), strict=True):
        own = bare(b"".join(found.word(i) for i in short[a:b].tolist())).decode()
        if len(own) >= RUN:
            parts = [own[i : i + RUN_WINDOW] for i in range(0, max(1, len(own) - RUN_WINDOW // 2), RUN_WINDOW // 2)]
            texts += [int(text[a])] * len(parts)
            runs += [p.encode() for p in parts]
    return texts, runs


def _joined(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = list(parts)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class Kernel:
    """Kernel values of words with fixed landmarks, as shares of the landmarks' own."""

    def __init__(self, landmarks: list[bytes]) -> None:
        self.letters = np.zeros(0x110002, np.int64)
        used = sorted({ord(c) for w in landmarks for c in w.decode()} | {_BEGIN, _END})
        self.letters[used] = np.arange(1, len(used) + 1)
        self.base = len(used) + 1
        self.shortest = min((len(w.decode()) for w in landmarks), default=0)
        word, code, weight = self._triples(*self._characters(landmarks), 0)
        self.codes, row = np.unique(code, return_inverse=True)
        # Row of each triple by its code, while a table of all codes is small.
        self.table = None
        if self.base**3 <= TABLE_CODES:
            self.table = np.full(self.base**3, -1, np.int32)
            self.table[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        self.phi = np.zeros((len(self.codes), len(landmarks)))
        np.add.at(self.phi, (row, word), weight)
        self.most = self.phi.max(1, initial=0)
        self.own = (self.phi**2).sum(0)
        self.gram = (self.phi.T @ self.phi) / np.sqrt(np.outer(self.own, self.own))
        self.phi = self.phi / self.own
        # Few landmarks share a triple: their places and values by triple.
        row, self.of = np.nonzero(self.phi)
        self.share = self.phi[row, self.of]
        self.first = np.searchsorted(row, np.arange(len(self.codes) + 1))

    @staticmethod
    def _characters(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all words in a row, and how many each has."""
        texts = [w.decode() for w in some]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))

    def _triples(self, points: np.ndarray, lengths: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, triple and weight of all triples that use landmark letters alone."""
        return _joined(self._found(points, lengths, stretch))

    def _rows(self, points: np.ndarray, lengths: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, row and weight of all triples that a landmark has."""
        parts = []
        for word, code, weight in self._found(points, lengths, stretch):
            if self.table is None:
                row = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = np.flatnonzero(self.codes[row] == code)
            else:
                row = self.table[code]
                hit = np.flatnonzero(row >= 0)
            parts.append((word[hit], row[hit].astype(np.int64), weight[hit]))
        return _joined(parts)

    def _found(self, points: np.ndarray, lengths: np.ndarray, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The triples, one pair of distances at a time."""
        # The signs for begin and end stand off as far as the letters of a stretched word.
        sizes = lengths + 2 + 2 * stretch
        ends = np.cumsum(sizes)
        letter, word = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32), np.repeat(np.arange(len(lengths)), sizes)
        at = np.arange(len(letter)) - np.repeat(ends - sizes, sizes)
        size = np.repeat(sizes, sizes)
        letter[(at > stretch) & (at < size - 1 - stretch)] = self.letters[points]
        letter[ends - sizes], letter[ends - 1] = self.letters[_BEGIN], self.letters[_END]
        live = letter > 0
        left = np.minimum(size - 1 - at, 127).astype(np.int8)  # characters up to the word's end
        for a, b, weight in _PLACES[stretch]:
            if len(letter) > b:
                first = np.flatnonzero(live[:-b] & live[a : a - b] & live[b:] & (left[:-b] >= b))
                code = (letter[first].astype(np.int64) * self.base + letter[first + a]) * self.base + letter[first + b]
                yield word[first], code, np.full(len(first), weight)

    def shares(self, some: list[bytes], step: int = 4000) -> Iterator[tuple[int, np.ndarray]]:
        """For words that resemble a landmark: their place and what they count for each landmark; once per stretch."""
        for lo in range(0, len(some), step):
            points, lengths = self._characters(some[lo : lo + step])
            for stretch in range(STRETCH + 1):
                # A word that any landmark's letters fill at this stretch, or almost.
                use = np.flatnonzero(lengths >= (self.shortest + stretch * (self.shortest - 1) - SKIPPED if stretch else 0))
                if not len(use):
                    break
                chosen = np.zeros(len(lengths), bool)
                chosen[use] = True
                word, row, weight = self._rows(points[np.repeat(chosen, lengths)], lengths[use], stretch)
                if not len(word):
                    continue
                hit = np.argsort(word * len(self.codes) + row, kind="stable")
                own, row, weight = word[hit], row[hit], weight[hit]
                if stretch:  # by chance many triples repeat in a long word
                    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (row[1:] != row[:-1])])
                    own, row, weight = own[first], row[first], np.minimum(np.add.reduceat(weight, first), self.most[row[first]])
                starts = self.first[row]
                several = self.first[row + 1] - starts
                at = np.repeat(starts - np.cumsum(several) + several, several) + np.arange(several.sum())
                cell = np.repeat(own * self.phi.shape[1], several) + self.of[at]
                value = np.bincount(cell, self.share[at] * np.repeat(weight, several), len(use) * self.phi.shape[1])
                live = np.unique(np.flatnonzero(value > SHARE) // self.phi.shape[1])
                value = np.clip((value.reshape(len(use), -1)[live] - SHARE) / (1 - SHARE), 0, 1).astype(np.float32)
                for place, v in zip((use[live] + lo).tolist(), value, strict=True):
                    yield place, v


@dataclass
class Model:
    """What scoring needs; a few hundred numbers and the landmarks."""

    landmarks: list[bytes]
    turn: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    flat: float | None = None

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(features), self.flat)
        z = self.slope * (turned(features, self.turn) @ self.weight + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def turned(features: np.ndarray, turn: np.ndarray) -> np.ndarray:
    m = len(turn)
    return np.hstack([features[:, :m] @ turn, features[:, m:] @ turn])


class Features:
    """Features of texts; remembers the words it has seen."""

    def __init__(self, landmarks: list[bytes], remembered: int = REMEMBERED) -> None:
        self.kernel, self.remembered = Kernel(landmarks), remembered
        self.n = len(landmarks)
        self._clear()

    def _clear(self) -> None:
        self.known = words.Known()
        self.values = np.zeros((1, self.n), np.float32)  # row 0: words that resemble no landmark
        self.used = 1

    def _add(self, some: list[bytes]) -> np.ndarray:
        places = np.zeros(len(some), np.int64)
        plain = [bare(w) for w in some]
        spelled = [i for i, w in enumerate(plain) if len(w) < len(some[i])]
        again = ((spelled[i], v) for i, v in self.kernel.shares([plain[i] for i in spelled]))
        for place, value in itertools.chain(self.kernel.shares(some), again):
            if places[place]:
                np.maximum(self.values[places[place]], value, out=self.values[places[place]])
                continue
            if self.used == len(self.values):
                self.values = np.vstack([self.values, np.zeros_like(self.values)])
            self.values[self.used] = value
            places[place] = self.used
            self.used += 1
        return places

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), 2 * self.n))
        if not self.n:
            return out
        found = trimmed(words.split(texts, words.NOT_SPACE))
        run_texts, runs = spelled_out(found)
        hashes = np.r_[found.hashes(), words.split(pa.array(runs, pa.string()), words.NOT_SPACE).hashes()] if runs else found.hashes()
        n = len(found.starts)
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.remembered or self.used > 100_000:
            self._clear()
        places = self.known.places(distinct, lambda new: self._add([found.word(i) if i < n else runs[i - n] for i in at[new].tolist()]))[back]
        live = np.flatnonzero(places)
        if len(live):
            text = np.r_[np.searchsorted(found.bounds, np.arange(n), side="right") - 1, np.array(run_texts, np.int64)][live]
            order = np.argsort(text, kind="stable")
            live, text = live[order], text[order]
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            value = self.values[places[live]]
            out[text[first], : self.n] = np.maximum.reduceat(value, first)
            out[text[first], self.n :] = np.log1p(np.add.reduceat(value**4, first))
        return out


def _rows_of(batches: Iterator[pa.RecordBatch], landmarks: list[bytes]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray]]:
    features = _features(tuple(landmarks))
    for batch in batches:
        texts = words.texts_of(batch.column("text_"))
        for lo, hi in words.slices(texts):
            yield batch, lo, hi, features(texts.slice(lo, hi - lo))


def _features(landmarks: tuple) -> Features:
    """One per worker process and set of landmarks."""
    return shared.per_worker("toxicity", landmarks, lambda: Features(list(landmarks)))


def _candidates(training: DataFrame) -> list[tuple[bytes, int, int]]:
    """Words with the toxic and other documents that hold them; only the most telling ones leave Spark."""
    text = shared.lower_ascii(F.coalesce(F.col("text_"), F.lit("")))
    bare = F.transform(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+$", ""))
    counts = (
        training.select("toxic", F.explode(F.array_distinct(bare)).alias("word"))
        .filter(F.octet_length("word") >= 3)
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("f"))
        .filter(F.col("t") >= MIN_DOCUMENTS)
    )
    telling = F.sqrt("t") * (F.log(F.col("t") + 0.5) - F.log(F.col("f") + 0.5))
    return [(r["word"].encode(), r["t"], r["f"]) for r in counts.orderBy(telling.desc(), "word").limit(CANDIDATES).collect()]


def choose(candidates: list[tuple[bytes, int, int]], toxic: int, other: int, most: int = LANDMARKS) -> list[bytes]:
    """The first candidates that are over-represented in toxic documents and unlike those before."""
    some = [w for w, t, f in candidates if (t + 0.5) / (toxic + 1) > 2 * (f + 0.5) / (other + 1)]
    if not some:
        return []
    gram = Kernel(some).gram
    chosen: list[int] = []
    for i in range(len(some)):
        if len(chosen) < most and not (chosen and gram[i, chosen].max() > 0.85):
            chosen.append(i)
    return [some[i] for i in chosen]


def fit(features: np.ndarray, toxic: np.ndarray, kernel: Kernel, landmarks: list[bytes]) -> Model:
    """Squared hinge loss by accelerated gradient steps; toxic rows weigh more, as they are fewer."""
    values, vectors = np.linalg.eigh(kernel.gram)
    turn = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    held = np.arange(len(toxic)) % 5 == 0
    if len(set(toxic[held])) < 2 or len(set(toxic[~held])) < 2:
        held = np.ones(len(toxic), bool)
        learn = held
    else:
        learn = ~held
    x, y = turned(features, turn), np.where(toxic == 1, 1.0, -1.0)
    scale = x[learn].std(0) + 0.02
    a = np.hstack([x[learn] / scale, np.ones((learn.sum(), 1))])
    sign = y[learn]
    cost = np.where(sign > 0, 3.0, 1.0) / len(sign)
    ridge = np.r_[np.full(a.shape[1] - 1, 2e-3), 0.0]
    step = 1 / (2 * np.linalg.norm(a * np.sqrt(cost)[:, None], 2) ** 2 + 2 * ridge.max())
    w = v = np.zeros(a.shape[1])
    for k in range(1500):
        slack = np.maximum(1 - sign * (a @ v), 0)
        gradient = -2 * a.T @ (sign * slack * cost) + 2 * ridge * v
        after = v - step * gradient
        v = after + k / (k + 3) * (after - w)
        w = after
    weight, bias = w[:-1] / scale, float(w[-1])
    margin = x[held] @ weight + bias
    target = (toxic[held] == 1).astype(float)
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        r, q = p - target, p * (1 - p) + 1e-6
        h = np.array([[(q * margin**2).sum() + 1e-2, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-2]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(h, [(r * margin).sum() + 1e-2 * (slope - 1), r.sum() + 1e-2 * shift])
    return Model(landmarks, turn, weight, bias, float(max(slope, 1e-3)), float(shift))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows that are not held out."""
    usable = labels.filter("doc_id is not null and toxic is not null").filter(shared.text_bucket(F.col("doc_id"), 4) != HELD_OUT)
    one = usable.groupBy(F.col("doc_id").alias("id_")).agg(F.max("toxic").cast("int").alias("toxic"))
    # At most ``rows`` rows, so the broadcast is bounded.
    chosen = F.broadcast(one.orderBy(F.xxhash64("id_"), "id_").limit(rows))
    own = documents.select(F.col("doc_id").alias("id_"), F.col("text").cast("string").alias("text_"))
    training = shared.written(own.join(chosen, "id_").select("id_", "toxic", "text_"), "toxicity-training")
    toxic, total = training.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    landmarks = choose(_candidates(training), toxic, total - toxic) if 0 < toxic < total else []
    if not landmarks:
        return Model([], np.zeros((0, 0)), np.zeros(0), 0.0, 1.0, 0.0, toxic / total if total else 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, x in _rows_of(batches, landmarks):
            lists = pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("id_").slice(lo, hi - lo), batch.column("toxic").slice(lo, hi - lo), lists], names=["id_", "toxic", "x"])

    kind = dict(own.dtypes)["id_"]
    found = training.mapInArrow(measure, f"id_ {kind}, toxic int, x array<float>").orderBy(F.xxhash64("id_"), "id_", "x").toPandas()
    return fit(np.stack(found["x"].to_numpy()).astype(float), found["toxic"].to_numpy(), Kernel(landmarks), landmarks)


def score(documents: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``keep`` and ``__score``; a kept column of that name gives way."""
    kept = [F.col(f"row_.c{i}").alias(c) for i, c in enumerate(keep) if c.lower() != "__score"]
    return _scored(documents, model, keep, text_col).select(*kept, F.col("score_").alias("__score"))


def _scored(documents: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row_``, a struct of the kept columns, and ``score_``."""
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, x in _rows_of(batches, model.landmarks):
            yield pa.RecordBatch.from_arrays([batch.column("row_").slice(lo, hi - lo), pa.array(model.scores(x))], names=["row_", "score_"])

    inner = ", ".join(f"c{i}: {kinds[c]}" for i, c in enumerate(keep))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    read = documents.select(row.alias("row_"), F.col(f"`{text_col}`").cast("string").alias("text_"))
    return read.mapInArrow(run, f"row_ struct<{inner}>, score_ double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``."""
    documents = shared.table(spark, sf_dir, "documents")
    model = train(documents, shared.table(spark, sf_dir, "labels"))
    return score(documents, model, ["doc_id"]).select(
        "doc_id",
        (shared.text_bucket(F.col("doc_id"), 4) == HELD_OUT).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= PREDICT).cast("int").alias("predicted"),
    )


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: toxic documents go; the others keep their columns."""
    model = train(docs, shared.table(spark, sf_dir, "labels"))
    clean = _scored(docs, model, docs.columns).filter(F.col("score_") < PREDICT)
    return clean.select(*[F.col(f"row_.c{i}").alias(c) for i, c in enumerate(docs.columns)])
