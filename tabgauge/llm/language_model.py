"""Language model scoring with an n-gram trie in Elias-Fano levels.

**Levels.** The first level holds every distinct training word: sorted 64-bit hashes, whose
rank is the word's id, and exact counts. The second holds every distinct pair. A context's
successors are a monotone sequence of (context, successor) in Elias-Fano code, the
pointers to where each context's successors begin another one, and each pair has its
discounted probability in one byte. A query finds its context's stretch and searches the
successor in it. Levels are files in the shared folder that tasks memory-map.

**Probabilities.** Absolute discounting: with counts ``c``, discounts ``D`` from the numbers of
words and pairs seen once and twice, and ``f`` distinct successors of a context ``u``,

    P(w) = (c(w) - D1) / N, all unknown words together D1 * V / N
    P(w | u) = (c(u, w) - D2) / c(u) + D2 * f(u) / c(u) * P(w)

and ``P(w)`` after a context that was never seen. Pairs carry the first term, pointers give
``f``.

**Work.** Words and pairs are counted per task and travel as sorted, packed runs, one row per
shard and run. Vocabulary shards are ranges of the hash, pair shards ranges of the
context's id; contexts with more than half a shard of pairs are spread over shards of their
own by successor. A shard holds about ``SHARD_TOKENS`` tokens, so their number grows with
the corpus. Texts never move.

Defined results: a null text is empty and consists of its end; a null id counts as an empty
text for the split; without training rows every word is unknown with probability 1 and the
score is 0; rows are kept one by one, repeated or not.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words
from .elias_fano import EliasFano

HELD_OUT = 2
MODULUS = 7
#: Tokens that one shard of the model stands for, about.
SHARD_TOKENS = 2_000_000
#: Distinct words or pairs that a task gathers before it passes them on.
GATHER = 1_200_000
#: Bytes of text that are scored together, so that a shard is asked often enough at once.
SCORE_BYTES = 2 << 20
#: Levels of a quantised probability.
LEVELS = 255

_END = words.seeded(1, 31)
_MOST_HOT = 256


# ---- packed runs of sorted keys with counts


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys as differences, mostly 32 bits each, and counts, mostly 8."""
    step = np.diff(keys, prepend=np.uint64(0))
    far = np.flatnonzero(step >= 0xFFFFFFFF)
    small = step.astype(np.uint32)
    small[far] = 0xFFFFFFFF
    many = np.flatnonzero(counts >= 255)
    few = np.minimum(counts, 255).astype(np.uint8)
    head = np.array([len(keys), len(far), len(many)], np.uint64)
    return b"".join(a.tobytes() for a in (head, step[far], counts[many].astype(np.uint64), small, few))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, f, m = (int(x) for x in np.frombuffer(data, np.uint64, 3))
    at = 24
    far = np.frombuffer(data, np.uint64, f, at)
    many = np.frombuffer(data, np.uint64, m, at + 8 * f)
    at += 8 * (f + m)
    step = np.frombuffer(data, np.uint32, n, at).astype(np.uint64)
    counts = np.frombuffer(data, np.uint8, n, at + 4 * n).astype(np.uint64)
    step[step == 0xFFFFFFFF] = far
    counts[counts == 255] = many
    return np.cumsum(step, dtype=np.uint64), counts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of several runs together, one of them unpacked at a time."""
    size = [int(np.frombuffer(r, np.uint64, 1)[0]) for r in runs]
    keys, counts, at = np.empty(sum(size), np.uint64), np.empty(sum(size), np.uint64), 0
    for run, n in zip(runs, size, strict=True):
        keys[at : at + n], counts[at : at + n] = unpack(run)
        at += n
    return _summed(keys, counts)


def _gathered(found: Iterator[np.ndarray], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with counts, some at a time."""
    keys, counts, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), [], 0
    for some in found:
        waiting.append(some)
        size += len(some)
        if size >= limit // 2:
            own = np.unique(np.concatenate(waiting), return_counts=True)
            keys, counts = _summed(np.r_[keys, own[0]], np.r_[counts, own[1].astype(np.uint64)])
            waiting, size = [], 0
            if len(keys) >= limit:
                yield keys, counts
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if waiting:
        own = np.unique(np.concatenate(waiting), return_counts=True)
        keys, counts = _summed(np.r_[keys, own[0]], np.r_[counts, own[1].astype(np.uint64)])
    if len(keys):
        yield keys, counts


# ---- texts to tokens


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of its end, and where each text begins."""
    found = words.split(texts, words.NOT_SPACE)
    h = np.insert(found.hashes(), found.bounds[1:], _END)
    return h, found.bounds + np.arange(len(found.bounds))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        texts = words.texts_of(batch.column("text_"))
        for lo, hi in words.slices(texts, SCORE_BYTES):
            yield batch.slice(lo, hi - lo), *_tokens(texts.slice(lo, hi - lo))


# ---- files


def _save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Arrays in one file of their own name, each at a multiple of 64 bytes."""
    files, base = shared.filesystem(folder)
    files.create_dir(base, recursive=True)
    name, at, head = uuid.uuid4().hex, 0, {}
    for key, a in arrays.items():
        head[key] = [str(a.dtype), len(a), at]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    with files.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % 64))
    return f"{folder}/{name}"


def _open(uri: str) -> dict[str, np.ndarray]:
    """Memory-mapped arrays of a file; read whole where the shared folder is no mounted one."""
    from pyarrow import fs

    files, path = shared.filesystem(uri)
    if isinstance(files, fs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r").view(np.ndarray)
    else:
        with files.open_input_stream(path) as source:
            data = np.frombuffer(source.read(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    body = data[8 + size :]
    return {k: body[at : at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in head.items()}


# ---- the model


class Vocabulary:
    """Ids and counts of words, over shards that are ranges of the hash."""

    def __init__(self, spec: dict) -> None:
        self.bits = spec["bits"]
        self.offset = np.cumsum([0, *[v["size"] for v in spec["vocabulary"]]])
        self.parts = [_open(v["file"]) if v["size"] else None for v in spec["vocabulary"]]
        self.size, self.total = spec["size"], spec["total"]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1 if unknown) and count of each hash."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        cuts = np.searchsorted(distinct >> np.uint64(64 - self.bits), np.arange(len(self.parts) + 1, dtype=np.uint64)) if self.bits else [0, len(distinct)]
        for s, part in enumerate(self.parts):
            a, b = cuts[s], cuts[s + 1]
            if part is None or a == b:
                continue
            keys = part["keys"]
            at = np.minimum(np.searchsorted(keys, distinct[a:b]), len(keys) - 1)
            hit = keys[at] == distinct[a:b]
            ids[a:b][hit] = at[hit] + self.offset[s]
            counts[a:b][hit] = part["counts"][at[hit]]
        return ids[back], counts[back]


class Layout:
    """Which shard a pair belongs to: by its context's id, or by successor for hot contexts."""

    def __init__(self, spec: dict) -> None:
        self.universe, self.plain = spec["universe"], spec["plain"]
        hot = sorted(spec["hot"])  # (context, shards, first shard)
        self.hot = np.array([h[0] for h in hot] or [-1], np.int64)
        self.spread = np.array([h[1] for h in hot] or [1], np.int64)
        self.first = np.array([h[2] for h in hot] or [0], np.int64)

    def is_hot(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
        return self.hot[at] == context, at

    def shard(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        hot, at = self.is_hot(context)
        return np.where(hot, self.first[at] + word * self.spread[at] // self.universe, context * self.plain // self.universe)

    def start(self, shard: int) -> int:
        """Lowest context of a shard."""
        if shard < self.plain:
            return -(-shard * self.universe // self.plain)
        return int(self.hot[np.searchsorted(self.first, shard, side="right") - 1])

    def contexts(self, shard: int) -> int:
        return self.start(shard + 1) - self.start(shard) if shard + 1 < self.plain else (self.universe - self.start(shard) if shard < self.plain else 1)


class Scorer:
    """The whole model, opened by a process."""

    def __init__(self, spec: dict) -> None:
        self.spec, self.vocabulary, self.layout = spec, Vocabulary(spec), Layout(spec)
        self.shards: dict[int, tuple] = {}
        for number, file in spec["pairs"].items():
            parts = _open(file)
            of = lambda name, parts=parts: EliasFano({k[len(name) :]: a for k, a in parts.items() if k.startswith(name)})
            self.shards[int(number)] = (of("pointer_"), of("successor_"), parts["probability"])
        self.book = 10.0 ** (spec["lowest"] * np.arange(LEVELS, -1, -1) / LEVELS)
        self.fanout = {int(c): sum(int(self.shards[s][1].n) for s in range(f, f + m) if s in self.shards) for c, m, f in spec["hot"]}

    def _pairs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probability of each pair (0 if unseen) and the number of the context's successors."""
        chance, fanout = np.zeros(len(context)), np.zeros(len(context))
        shard = self.layout.shard(context, np.maximum(word, 0))
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]]) if len(order) else []
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            at = order[a:b]
            number = int(shard[at[0]])
            if number not in self.shards:
                continue
            pointer, successor, probability = self.shards[number]
            own = context[at] - self.layout.start(number)
            if number >= self.layout.plain:
                fanout[at] = self.fanout[int(context[at[0]])]
            else:
                # Distinct contexts only: a slice repeats the frequent ones.
                some, back = np.unique(own, return_inverse=True)
                fanout[at] = (pointer.access(some + 1) - pointer.access(some)).astype(np.int64)[back]
            known = at[word[at] >= 0]
            place = successor.find((context[known] - self.layout.start(number)) * self.layout.universe + word[known])
            hit = place >= 0
            chance[known[hit]] = self.book[probability[place[hit]]]
        return chance, fanout

    def score(self, hashes: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, base score and score."""
        spec = self.spec
        n, v = spec["total"], spec["size"]
        ids, counts = self.vocabulary.look_up(hashes)
        firsts = bounds[:-1]
        base = np.log10((counts + 1) / (n + v + 1))
        if n:
            d1, d2 = spec["d1"], spec["d2"]
            one = np.where(ids >= 0, np.maximum(counts - d1, 1e-9) / n, d1 * v / n)
            context, seen = np.empty_like(ids), np.empty(len(ids))
            context[1:], seen[1:] = ids[:-1], counts[:-1]
            context[firsts], seen[firsts] = v, spec["texts"]  # id of the beginning
            chance = one.copy()
            after = np.flatnonzero(context >= 0)
            pair, fanout = self._pairs(context[after], ids[after])
            chance[after] = pair + d2 * fanout / seen[after] * one[after]
            # Rounded probabilities of a context may exceed 1 by a step.
            score = np.log10(np.minimum(chance, 1.0))
        else:
            score = np.zeros(len(ids))
        add = lambda x: np.add.reduceat(x, firsts) if len(firsts) else x
        return {"n_tokens": np.diff(bounds), "n_known": add((ids >= 0).astype(np.int64)), "base_score": add(base), "score": add(score)}


_scorers: dict[str, Scorer] = {}


def _scorer(spec: dict) -> Scorer:
    """One per worker process and model."""
    if spec["name"] not in _scorers:
        _scorers.clear()
        _scorers[spec["name"]] = Scorer(spec)
    return _scorers[spec["name"]]


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(spec: dict) -> Vocabulary:
    if spec["name"] not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[spec["name"]] = Vocabulary(spec)
    return _vocabularies[spec["name"]]


# ---- training


def _rounded(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def train(training: DataFrame, text_col: str = "text", shard_tokens: int = SHARD_TOKENS, gather: int = GATHER) -> dict:
    """Count, write the levels, and describe the model: names of files and a few numbers per shard."""
    spark = training.sparkSession
    folder = shared.new_folder(spark, "ngram-trie")
    read = training.select(F.col(f"`{text_col}`").cast("string").alias("text_"))
    # One number from the data sets the number of shards: white-space runs come close to tokens.
    about = read.agg(F.sum(F.octet_length("text_")), F.count("*")).first()
    shards = _rounded(max(1, -(-((about[0] or 0) // 6 + about[1]) // shard_tokens)))
    bits = shards.bit_length() - 1
    run = "shard int, run binary"

    def word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _gathered((h for _, h, _ in _slices(batches)), gather):
            cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(shards + 1, dtype=np.uint64)) if bits else np.array([0, len(keys)])
            yield _runs(keys, counts, cuts)

    def word_shard(table: pa.Table) -> pa.Table:
        keys, counts = merged(table.column("run").to_pylist())
        file = _save(folder, {"keys": keys, "counts": counts.astype(np.int64)})
        top = np.argsort(-counts.astype(np.int64), kind="stable")[:_MOST_HOT]
        return pa.table({
            "shard": table.column("shard")[:1], "file": [file], "size": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()),
            "once": pa.array([int((counts == 1).sum())], pa.int64()), "twice": pa.array([int((counts == 2).sum())], pa.int64()),
            "places": pa.array([top.tolist()], pa.list_(pa.int64())), "counts": pa.array([counts[top].astype(np.int64).tolist()], pa.list_(pa.int64())),
        })

    made = "shard int, file string, size bigint, total bigint, once bigint, twice bigint"
    level = shared.written(read.mapInArrow(word_runs, run).groupBy("shard").applyInArrow(word_shard, made + ", places array<bigint>, counts array<bigint>"), "vocabulary")
    found = {r["shard"]: r for r in level.collect()}
    vocabulary = [{"file": found[s]["file"], "size": found[s]["size"]} if s in found else {"file": "", "size": 0} for s in range(shards)]
    offset = np.cumsum([0, *[v["size"] for v in vocabulary]]).tolist()
    total = sum(r["total"] for r in found.values())
    size = offset[-1]
    spec = {"name": folder, "bits": bits, "vocabulary": vocabulary, "size": size, "total": total, "texts": about[1], "universe": size + 1}
    if not total:
        return spec | {"plain": 1, "hot": [], "pairs": {}, "d1": 0.5, "d2": 0.5, "lowest": -1.0}
    hot, spread = [], shards
    counted = [(offset[s] + p, c) for s, r in found.items() for p, c in zip(r["places"], r["counts"], strict=True)] + [(size, about[1])]
    for word, count in sorted(counted):
        if 2 * count * shards > total and shards > 1:
            parts = -(-2 * count * shards // total)
            hot.append([word, parts, spread])
            spread += parts
    spec |= {"plain": shards, "hot": hot, "d1": _discount(sum(r["once"] for r in found.values()), sum(r["twice"] for r in found.values()))}

    def pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, layout = _vocabulary(spec), Layout(spec)

        def pairs() -> Iterator[np.ndarray]:
            for _, h, bounds in _slices(batches):
                ids, _ = vocabulary.look_up(h)
                context = np.empty_like(ids)
                context[1:] = ids[:-1]
                context[bounds[:-1]] = size
                yield (context * spec["universe"] + ids).astype(np.uint64)

        for keys, counts in _gathered(pairs(), gather):
            shard = layout.shard((keys // np.uint64(spec["universe"])).astype(np.int64), (keys % np.uint64(spec["universe"])).astype(np.int64))
            order = np.argsort(shard, kind="stable")
            yield _runs(keys[order], counts[order], np.searchsorted(shard[order], np.arange(spread + 1)))

    def pair_counts(table: pa.Table) -> pa.Table:
        keys, counts = merged(table.column("run").to_pylist())
        file = _save(folder, {"keys": keys, "counts": counts.astype(np.uint32)})
        return pa.table({
            "shard": table.column("shard")[:1], "file": [file], "size": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()),
            "once": pa.array([int((counts == 1).sum())], pa.int64()), "twice": pa.array([int((counts == 2).sum())], pa.int64()),
        })

    level = shared.written(read.mapInArrow(pair_runs, run).groupBy("shard").applyInArrow(pair_counts, made), "pairs")
    ones, twos = level.agg(F.sum("once"), F.sum("twice")).first()
    most = max(about[1], max((c for _, c in counted), default=1))
    spec |= {"d2": _discount(ones, twos)}
    spec |= {"lowest": math.log10(max(1 - spec["d2"], 1e-3) / most) - 0.01}

    def pair_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, layout = _vocabulary(spec), Layout(spec)
        for batch in batches:
            for number, file in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist(), strict=True):
                parts = _open(file)
                file = _save(folder, _level(parts["keys"], parts["counts"], number, spec, vocabulary, layout))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([file])], names=["shard", "file"])

    levels = shared.written(level.select("shard", "file").repartition("shard").mapInArrow(pair_level, "shard int, file string"), "levels")
    return spec | {"pairs": {r["shard"]: r["file"] for r in levels.collect()}}


def _runs(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    some = [s for s in range(len(cuts) - 1) if cuts[s] < cuts[s + 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([pack(keys[cuts[s] : cuts[s + 1]], counts[cuts[s] : cuts[s + 1]]) for s in some], pa.binary())], names=["shard", "run"]
    )


def _level(keys: np.ndarray, counts: np.ndarray, number: int, spec: dict, vocabulary: Vocabulary, layout: Layout) -> dict[str, np.ndarray]:
    """Pointers, successors and probabilities of one shard's pairs."""
    universe = np.uint64(spec["universe"])
    start, n = layout.start(number), layout.contexts(number)
    own = keys - np.uint64(start) * universe
    context = (own // universe).astype(np.int64)
    pointers = np.searchsorted(context, np.arange(n + 1))
    seen = _context_counts(start, n, spec, vocabulary)[context]
    log = np.log10((counts - spec["d2"]) / seen)
    level = np.clip(np.rint(LEVELS - log / spec["lowest"] * LEVELS), 0, LEVELS).astype(np.uint8)
    out = {f"pointer_{k}": a for k, a in EliasFano.build(pointers, len(keys) + 1).items()}
    out |= {f"successor_{k}": a for k, a in EliasFano.build(own, n * spec["universe"]).items()}
    return out | {"probability": level}


def _context_counts(start: int, n: int, spec: dict, vocabulary: Vocabulary) -> np.ndarray:
    """How often each context of a range occurs: a word's count, or the number of texts for the beginning."""
    out = np.zeros(n, np.int64)
    for s, part in enumerate(vocabulary.parts):
        a, b = max(start, int(vocabulary.offset[s])), min(start + n, int(vocabulary.offset[s + 1]))
        if part is not None and a < b:
            out[a - start : b - start] = part["counts"][a - int(vocabulary.offset[s]) : b - int(vocabulary.offset[s])]
    if start <= spec["size"] < start + n:
        out[spec["size"] - start] = spec["texts"]
    return out


def score(documents: DataFrame, spec: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``keep`` with tokens, known tokens, base score and score of each text."""
    kinds = dict(documents.dtypes)
    sent = documents.sparkSession.sparkContext.broadcast(spec)  # names of files, a few numbers per shard
    names = ("n_tokens", "n_known", "base_score", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for batch, hashes, bounds in _slices(batches):
            found = scorer.score(hashes, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("row_"), *[pa.array(found[c]) for c in names]], names=["row_", *names])

    inner = ", ".join(f"c{i}: {kinds[c]}" for i, c in enumerate(keep))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    read = documents.select(row.alias("row_"), F.col(f"`{text_col}`").cast("string").alias("text_"))
    found = read.mapInArrow(run, f"row_ struct<{inner}>, n_tokens bigint, n_known bigint, base_score double, score double")
    # A kept column with the name of a result gives way.
    return found.select(*[F.col(f"row_.c{i}").alias(c) for i, c in enumerate(keep) if c not in names], *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by a model of those that are not held out."""
    documents = shared.table(spark, sf_dir, "documents")
    held_out = shared.text_bucket(F.col("doc_id"), MODULUS) == HELD_OUT
    spec = train(documents.filter(~held_out))
    found = score(documents, spec, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(spec["total"]).cast("bigint").alias("train_tokens"), "base_score", "score")
