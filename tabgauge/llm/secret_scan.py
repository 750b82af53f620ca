"""Secret scans: patterns, and a linear-chain conditional random field over tokens.

**Patterns** (base spans). ``assign``: a keyword, a sign and a value; ``access``: an access key;
``hex``: a long run of lower-case hexadecimal digits. A byte-level look at a slice of texts
finds the few that can match at all.

**Field.** Tokens are runs of letters, digits, ``+ / _ . -`` and characters beyond ASCII. Each is
begin, inside or outside of a secret. Its features are its own shape (length, kinds of
characters, changes between them), its neighbours (keywords, signs and quotes before and
after) and its file (signs of code, keywords anywhere). Weights and transitions maximise
the likelihood of windows of tokens (forward-backward), labelled by the patterns: at most
``TRAIN_WINDOWS``, those with secrets by hash from all documents, the others from a bounded
sample. Copies of the windows with secrets replaced by random
strings of other alphabets, and without keyword or quotes, keep the field from learning
the patterns only.

**Decoding** is exact Viterbi. A token whose outside score leads by more than any two
transitions could win back is outside in every best path; only the stretches between such
tokens are decoded step by step. Spans of the field that touch no base span are added.

Offsets are code points, ends exclusive. Defined results: a null text is an empty one; rows
are kept one by one, repeated or not; without a single pattern match in all documents
there is no field and base spans stand alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words

#: Documents, about, that training takes windows without secrets from, and most windows in all.
TRAIN_ROWS = 20_000
TRAIN_WINDOWS = 4000
#: Tokens of a training window, the secret in the middle.
WINDOW = 21
#: Lead of the secret states over outside that a span of the field needs, in log-odds per token.
LEAD = 2.0

KINDS = ("assign", "access", "hex", "crf")

# Fixed value: the patterns of the base spans.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_LENGTH = {"assign": 6, "access": 20, "hex": 24}

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "key", "pwd", "auth", "bearer", "credential")
_TOKEN = words.byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")
_DIGIT, _UPPER, _LOWER, _HEXLOW = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = True
_HEXLOW[48:58] = _HEXLOW[97:103] = True
_HEXANY = _HEXLOW.copy()
_HEXANY[65:71] = True


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``(start, end, kind, start of the value)`` of all base spans, by start and kind."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= MIN_LENGTH["assign"]:
            out.append((m.start(), m.end(), "assign", m.start(2)))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        if kind == "hex" or "AKIA" in text:
            out += [(m.start(), m.end(), kind, m.start()) for m in pattern.finditer(text) if m.end() - m.start() >= MIN_LENGTH[kind]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _may_match(texts: pa.Array) -> np.ndarray:
    """Texts that a pattern can match: a long run of hex digits, an access key's sign, or a sign with a keyword."""
    data, offsets = words.raw_bytes(texts)
    out = np.zeros(len(texts), bool)
    runs = np.r_[0, np.cumsum(_HEXLOW[data])]
    n = MIN_LENGTH["hex"]
    if len(data) >= n:
        at = np.flatnonzero(runs[n:] - runs[:-n] == n)
        out[np.searchsorted(offsets, at, side="right") - 1] = True
    out[words.texts_with(texts, b"AKIA")] = True
    sign = np.flatnonzero((data == 0x3A) | (data == 0x3D))
    for i in np.unique(np.searchsorted(offsets, sign, side="right") - 1).tolist():
        if not out[i]:
            low = texts[i].as_py().lower()
            out[i] = any(k in low for k in ("passw", "secret", "token", "api"))
    return out


# ---- features

_BINS = (6, 12, 20, 32, 64)
FEATURES = (
    ["bias", *[f"length>={b}" for b in _BINS]]
    + ["lower", "upper", "digit", "sign", "wide", "all hex", "all digits", "letters only", "lower and digit", "upper and digit", "capital first"]
    + ["changes>=2", "changes>=4", "changes>=8", "digits>20%", "digits>50%", "digits>90%"]
    + ["long and changes", "keyword before", "keyword two before", "assignment before", "quote before", "quote after", "keyword and assignment", "line start", "line end"]
    + ["file has assignment", "file has keyword", "file has braces", "file many digits"]
)
_AT = {name: i for i, name in enumerate(FEATURES)}


def _keyword_hashes() -> np.ndarray:
    found = words.split(pa.array([" ".join(_KEYWORDS)]), _TOKEN)
    return np.sort(found.hashes())


_KEYWORD_HASHES = _keyword_hashes()


def features(texts: pa.Array) -> tuple[words.Words, np.ndarray]:
    """Tokens of a slice of texts, in their own case, and a row of features for each."""
    found = words.split(texts, _TOKEN, lower=False)
    data, s, e = found.data, found.starts, found.ends
    n = len(s)
    x = np.zeros((n, len(FEATURES)), np.float32)
    if not n:
        return found, x

    def inside(table: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(table[data], dtype=np.int32)]
        return c[e] - c[s]

    def put(name: str, value: np.ndarray) -> None:
        x[:, _AT[name]] = value

    size = e - s
    lower, upper, digit, hexes = inside(_LOWER), inside(_UPPER), inside(_DIGIT), inside(_HEXANY)
    wide = inside(_WIDE)
    sign = size - lower - upper - digit - wide
    kind = _KIND[data]
    turn = np.zeros(len(data) + 1, np.int32)
    turn[2:] = np.cumsum((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0))
    changes = turn[e] - turn[s + 1]
    put("bias", np.ones(n))
    for b in _BINS:
        put(f"length>={b}", size >= b)
    for name, value in (("lower", lower), ("upper", upper), ("digit", digit), ("sign", sign), ("wide", wide)):
        put(name, value > 0)
    put("all hex", hexes == size)
    put("all digits", digit == size)
    put("letters only", lower + upper + wide == size)
    put("lower and digit", (lower > 0) & (digit > 0))
    put("upper and digit", (upper > 0) & (digit > 0))
    put("capital first", _UPPER[data[s]] & (lower > 0) & (upper == 1))
    for b in (2, 4, 8):
        put(f"changes>={b}", changes >= b)
    for b in (20, 50, 90):
        put(f"digits>{b}%", 100 * digit > b * size)
    put("long and changes", (size >= 16) & (changes >= 4) & (digit > 0))
    low = words.Words(words.LOWER[data], s, e, found.bounds, found.offsets)
    hashes = low.hashes()
    key = _KEYWORD_HASHES[np.minimum(np.searchsorted(_KEYWORD_HASHES, hashes), len(_KEYWORD_HASHES) - 1)] == hashes
    text = np.repeat(np.arange(len(texts)), found.counts())
    first = np.r_[True, text[1:] != text[:-1]]
    second = np.r_[True, first[:-1]]
    before = np.r_[False, key[:-1]] & ~first
    two = np.r_[False, False, key[:-2]][:n] & ~first & ~second
    put("keyword before", before)
    put("keyword two before", two)
    # What stands between a token and the one before it, up to a few bytes.
    padded = np.r_[np.zeros(4, np.uint8), data, np.zeros(4, np.uint8)]
    gap = np.where(first, s - found.offsets[text], s - np.r_[0, e[:-1]])
    assign, quote = np.zeros(n, bool), np.zeros(n, bool)
    line = first & (gap < 1)
    for i in range(1, 5):
        b = padded[s + 4 - i]
        near = gap >= i
        assign |= near & ((b == 0x3A) | (b == 0x3D))
        quote |= near & ((b == 0x22) | (b == 0x27))
        line |= near & (b == 0x0A)
    last = np.r_[first[1:], True]
    after = padded[e + 4]
    put("assignment before", assign)
    put("quote before", quote)
    put("quote after", (after == 0x22) | (after == 0x27))
    put("keyword and assignment", assign & (before | two))
    put("line start", line)
    put("line end", (after == 0x0A) | last & (e == found.offsets[text + 1]))

    def per_text(table: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(table[data], dtype=np.int64)][found.offsets]
        return np.diff(c)[text]

    length = np.maximum(np.diff(found.offsets)[text], 1)
    put("file has assignment", per_text(_EQUALS) > 0)
    keys = np.r_[0, np.cumsum(key)][found.bounds]
    put("file has keyword", np.diff(keys)[text] > 0)
    put("file has braces", per_text(_BRACES) > 0)
    put("file many digits", 20 * per_text(_DIGIT) > length)
    return found, x


_WIDE = np.zeros(256, bool)
_WIDE[128:] = True
_KIND = (_LOWER * 1 + _UPPER * 2 + _DIGIT * 3).astype(np.int8)
_EQUALS, _BRACES = np.zeros(256, bool), np.zeros(256, bool)
_EQUALS[0x3D] = _BRACES[[0x7B, 0x7D, 0x3B]] = True


# ---- the field


@dataclass
class Field:
    """Weights of features per state (outside, begin, inside) and of transitions."""

    weight: np.ndarray
    step: np.ndarray

    def decode(self, score: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """States of all tokens of all texts; exact."""
        out = np.zeros(len(score), np.int8)
        most = 2 * (self.step.max() - self.step.min())
        open_ = np.flatnonzero(score[:, 0] - score[:, 1:].max(1) <= most)
        if not len(open_):
            return out
        text = np.searchsorted(bounds, open_, side="right") - 1
        cut = np.flatnonzero(np.r_[True, (open_[1:] != open_[:-1] + 1) | (text[1:] != text[:-1])])
        for a, b in zip(cut, [*cut[1:], len(open_)], strict=True):
            lo, hi = int(open_[a]), int(open_[b - 1]) + 1
            starts, ends = lo == bounds[text[a]], hi == bounds[text[a] + 1]
            out[lo:hi] = viterbi(score[lo:hi], self.step, not starts, not ends)
        return out


def viterbi(score: np.ndarray, step: np.ndarray, after_outside: bool, before_outside: bool) -> np.ndarray:
    """Best states of a chain, between outside tokens where there are some."""
    best = score[0] + (step[0] if after_outside else 0)
    back = np.zeros(score.shape, np.int8)
    for t in range(1, len(score)):
        all_ = best[:, None] + step
        back[t] = all_.argmax(0)
        best = all_.max(0) + score[t]
    if before_outside:
        best = best + step[:, 0]
    out = np.zeros(len(score), np.int8)
    out[-1] = best.argmax()
    for t in range(len(score) - 1, 0, -1):
        out[t - 1] = back[t][out[t]]
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def fit(x: np.ndarray, y: np.ndarray, mask: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> Field:
    """Maximise the likelihood of windows ``x`` (n, length, features) with states ``y``; Adam steps."""
    n, length, f = x.shape
    w, t = np.zeros((f, 3)), np.zeros((3, 3))
    w[_AT["bias"]] = (1.0, -1.0, -1.5)
    hot = np.eye(3)[y] * mask[:, :, None]
    both = mask[:, 1:] * mask[:, :-1]
    seen = np.einsum("nta,ntb,nt->ab", hot[:, :-1], hot[:, 1:], both)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for k in range(1, rounds + 1):
        score = (x.reshape(-1, f) @ w).reshape(n, length, 3) * mask[:, :, None]
        fore, aft = np.zeros_like(score), np.zeros_like(score)
        fore[:, 0] = score[:, 0]
        for i in range(1, length):
            on = _logsum(fore[:, i - 1, :, None] + t, 1) + score[:, i]
            fore[:, i] = np.where(both[:, i - 1, None] > 0, on, np.where(mask[:, i, None] > 0, score[:, i], fore[:, i - 1]))
        for i in range(length - 2, -1, -1):
            on = _logsum(t + (score[:, i + 1] + aft[:, i + 1])[:, None, :], 2)
            aft[:, i] = np.where(both[:, i, None] > 0, on, 0)
        whole = fore + aft
        z = _logsum(whole, 2)
        chance = np.exp(whole - z[:, :, None]) * mask[:, :, None]
        pair = np.exp(fore[:, :-1, :, None] + t + (score[:, 1:] + aft[:, 1:])[:, :, None, :] - z[:, 1:, None, None]) * both[:, :, None, None]
        gw = x.reshape(-1, f).T @ (hot - chance).reshape(-1, 3) / n - ridge * w
        gt = (seen - pair.sum((0, 1))) / n - ridge * t
        for value, g, a, b in ((w, gw, 0, 1), (t, gt, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.99 * moments[b] + 0.01 * g * g
            value += 0.1 * (moments[a] / (1 - 0.9**k)) / (np.sqrt(moments[b] / (1 - 0.99**k)) + 1e-8)
    return Field(w, t)


# ---- training windows

_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789")


def _varied(text: str, spans: list, random: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """A copy of a text whose secrets have other alphabets; half of them without keyword, sign and quotes."""
    out, values, at = [], [], 0
    size = 0
    for start, end, _, value in spans:
        if start < at:
            continue
        keep = text[at : start if random.random() < 0.5 else value]
        letters = _ALPHABETS[random.integers(len(_ALPHABETS))]
        new = "".join(letters[i] for i in random.integers(len(letters), size=max(20, end - value)))
        if random.random() < 0.3:  # a short name of the issuer in front
            new = "".join(_ALPHABETS[4][i] for i in random.integers(26, size=3)) + "_-"[random.integers(2)] + new
        out += [keep, new]
        size += len(keep)
        values.append((size, size + len(new)))
        size += len(new)
        at = end
    return "".join(out) + text[at:], values


def _windows(texts: list[str], values: list[list[tuple[int, int]]]) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Windows around secrets, and one from the middle of each text without."""
    column = pa.array(texts, pa.string())
    found, x = features(column)
    for i, spans in enumerate(values):
        lo, hi = int(found.bounds[i]), int(found.bounds[i + 1])
        if lo == hi:
            continue
        raw, base = texts[i], found.offsets[i]
        y = np.zeros(hi - lo, np.int8)
        centres = []
        for a, b in spans:
            first, end = base + len(raw[:a].encode()), base + len(raw[:b].encode())
            t0, t1 = np.searchsorted(found.ends[lo:hi], first, side="right"), np.searchsorted(found.starts[lo:hi], end, side="left")
            if t0 < t1:
                y[t0:t1] = 2
                y[t0] = 1
                centres.append((int(t0) + int(t1)) // 2)
        for c in centres or [(hi - lo) // 2]:
            a = max(0, min(c - WINDOW // 2, hi - lo - WINDOW))
            yield bool(centres), x[lo + a : min(hi, lo + a + WINDOW)], y[a : a + WINDOW]


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = words.texts_of(batch.column("text_"))
        for lo, hi in words.slices(texts):
            part = texts.slice(lo, hi - lo)
            sampled = batch.column("sampled_").slice(lo, hi - lo).to_pylist()
            found = {i: base_spans(part[i].as_py()) for i in np.flatnonzero(_may_match(part)).tolist()}
            use = [i for i, s in enumerate(sampled) if s or found.get(i)]
            every, spans = [part[i].as_py() for i in use], [found.get(i, []) for i in use]
            plain = [[(v, e) for _, e, _, v in s] for s in spans]
            # The random copies depend on the text alone.
            copies = [_varied(t, s, np.random.default_rng(len(t) * 1000003 + s[0][0])) for t, s in zip(every, spans, strict=True) if s]
            rows = [*_windows(every, plain), *(_windows([c for c, _ in copies], [v for _, v in copies]) if copies else [])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.bool_()),
                    pa.array([r[1].astype(np.uint8).tobytes() for r in rows], pa.binary()),
                    pa.array([r[2].tobytes() for r in rows], pa.binary()),
                ],
                names=["secret", "x", "y"],
            )


def train(documents: DataFrame, rows: int = TRAIN_ROWS, windows: int = TRAIN_WINDOWS) -> Field | None:
    """A field from the base spans of all documents, and about ``rows`` documents, by hash of the id, for windows without; null without any base span."""
    own = documents.select(F.col("doc_id").cast("string").alias("id_"), F.col("text").cast("string").alias("text_"))
    every = max(1, documents.count() // rows)
    flagged = own.select("text_", (F.pmod(F.xxhash64("id_", F.lit(17)), F.lit(every)) == 0).alias("sampled_"))
    found = shared.written(flagged.mapInArrow(_training, "secret boolean, x binary, y binary"), "windows")
    some = [w.orderBy(F.xxhash64("x", "y"), "x", "y").limit(windows // 2).toPandas() for w in (found.filter("secret"), found.filter("not secret"))]
    if not len(some[0]):
        return None
    x = np.zeros((sum(map(len, some)), WINDOW, len(FEATURES)))
    y, mask = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2])
    at = 0
    for frame in some:
        for a, b in zip(frame["x"], frame["y"], strict=True):
            n = len(b)
            x[at, :n] = np.frombuffer(a, np.uint8).reshape(n, -1)
            y[at, :n] = np.frombuffer(b, np.int8)
            mask[at, :n] = 1
            at += 1
    return fit(x, y, mask)


# ---- scanning


def find(texts: pa.Array, field: Field | None) -> list[list[tuple[int, int, str, int]]]:
    """All spans of each text, as ``base_spans`` gives them, with those of the field."""
    out: list[list] = [[] for _ in range(len(texts))]
    for i in np.flatnonzero(_may_match(texts)).tolist():
        out[i] = base_spans(texts[i].as_py())
    if field is None:
        return out
    found, x = features(texts)
    score = x @ field.weight.astype(np.float32)
    score[:, 0] += LEAD
    state = field.decode(score, found.bounds)
    inside = np.flatnonzero(state)
    if not len(inside):
        return out
    text = np.searchsorted(found.bounds, inside, side="right") - 1
    new = np.flatnonzero(np.r_[True, (inside[1:] != inside[:-1] + 1) | (text[1:] != text[:-1]) | (state[inside[1:]] == 1)])
    for a, b in zip(new, [*new[1:], len(inside)], strict=True):
        i = int(text[a])
        raw, base = texts[i].as_py().encode(), found.offsets[i]
        start = len(raw[: found.starts[inside[a]] - base].decode())
        end = start + len(raw[found.starts[inside[a]] - base : found.ends[inside[b - 1]] - base].decode())
        if not any(s < end and start < e for s, e, kind, _ in out[i]):
            out[i].append((start, end, "crf", start))
    return [sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))) for spans in out]


def scan(documents: DataFrame, field: Field | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``keep``, ``__spans`` (kind, start, end, start of the value) and ``__clean``, the text with values replaced.

    Kept columns of these names give way.
    """
    kept = [F.col(f"row_.c{i}").alias(c) for i, c in enumerate(keep) if c.lower() not in ("__spans", "__clean")]
    return _scanned(documents, field, keep, text_col).select(*kept, F.col("spans_").alias("__spans"), F.col("clean_").alias("__clean"))


def _scanned(documents: DataFrame, field: Field | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row_``, a struct of the kept columns, ``spans_`` and ``clean_``."""
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.texts_of(batch.column("text_"))
            for lo, hi in words.slices(texts):
                part = texts.slice(lo, hi - lo)
                found = find(part, field)
                touched = {i for i, s in enumerate(found) if s}
                clean = [redacted(part[i].as_py(), found[i]) if i in touched else None for i in range(len(part))]
                rows = [[{"kind": k, "start": s, "end": e, "value": v} for s, e, k, v in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([batch.column("row_").slice(lo, hi - lo), pa.array(rows, _SPANS), pa.array(clean, pa.string())], names=["row_", "spans_", "clean_"])

    inner = ", ".join(f"c{i}: {kinds[c]}" for i, c in enumerate(keep))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    read = documents.select(row.alias("row_"), F.col(f"`{text_col}`").cast("string").alias("text_"))
    span = "array<struct<kind: string, start: bigint, end: bigint, value: bigint>>"
    return read.mapInArrow(run, f"row_ struct<{inner}>, spans_ {span}, clean_ string")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))
REPLACED = "[SECRET]"


def redacted(text: str, spans: list[tuple[int, int, str, int]]) -> str:
    """The text with the values of all spans replaced, overlapping ones together."""
    out, at = [], 0
    for value, end in sorted((v, e) for _, e, _, v in spans):
        if value >= at:
            out += [text[at:value], REPLACED]
        at = max(at, end)
    return "".join(out) + text[at:]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    documents = shared.table(spark, sf_dir, "documents")
    found = scan(documents, train(documents), ["doc_id"])
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("__spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(named(base), 256).alias("base_sha256"),
        named(F.col("__spans")).alias("spans"),
    )


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets' values are replaced; all documents stay, and ``n_chars`` follows the text."""
    found = _scanned(docs, train(docs), docs.columns)
    changed = F.size("spans_") > 0
    own = {c: F.col(f"row_.c{i}") for i, c in enumerate(docs.columns)}
    values = {"text": F.when(changed, F.col("clean_")).otherwise(own["text"])}
    if "n_chars" in own:
        kind = dict(docs.dtypes)["n_chars"]
        values["n_chars"] = F.when(changed, F.char_length("clean_").cast(kind)).otherwise(own["n_chars"])
    return found.select(*[values.get(c, own[c]).alias(c) for c in docs.columns])
