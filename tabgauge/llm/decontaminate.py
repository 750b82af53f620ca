"""Benchmark decontamination with a generalised suffix automaton.

Words are runs of letters, digits and characters beyond ASCII, after A-Z became a-z. A
window is ``window`` consecutive words of an item; an item with fewer words, but not
none, is one window as a whole.

The items' words become an automaton. Every document streams through it, and the longest
length that matches at each word shows which windows end there. Only runs of words that
occur in items at all, and are long enough for the shortest window, need the automaton;
both are found with array operations over a slice of documents.

Items are dealt into blocks of about ``BLOCK_WORDS`` words. Tasks build one automaton per
block and leave it in the shared folder; tasks that read documents take one block after
the other, so their memory does not grow with the benchmark.

Defined results: a null text has no words. A null item id counts as the text ``null``.
Repeated documents each give a row; an item id that occurs in several rows counts once.
Without items nothing is hit. Columns of the documents other than those read are carried along.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words
from .suffix_automaton import SuffixAutomaton

#: Words of the window that counts as a leak.
WINDOW = 10
#: Words of items in one automaton, about.
BLOCK_WORDS = 100_000
#: Of a document's words, the share from which on the whole document goes.
MAX_COVERAGE = 0.5

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Block:
    """The automaton of some items, over ids of the words that occur in them."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int) -> None:
        found = words.split(texts, words.WORD_CHARS)
        hashes = found.hashes()
        self.vocabulary = np.unique(hashes)
        tokens = np.searchsorted(self.vocabulary, hashes).tolist()
        self.window = window
        self.automaton = SuffixAutomaton()
        self.shortest = window
        for name, lo, hi in zip(ids, found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
            if hi == lo:
                continue
            item = tokens[lo:hi]
            size = min(window, len(item))
            self.shortest = min(self.shortest, size)
            self.automaton.add(item)
        for name, lo, hi in zip(ids, found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
            size = min(window, hi - lo)
            for at in range(lo, hi - size + 1) if size else ():
                self.automaton.mark(tokens[at : at + size], name)
        self.automaton.finish()

    def find(self, found: words.Words, hashes: np.ndarray, hit: np.ndarray, longest: np.ndarray, items: dict) -> None:
        """Mark hit words, each text's longest match, and the items found in it."""
        if not len(self.vocabulary) or not len(hashes):
            return
        place = np.searchsorted(self.vocabulary, hashes)
        place[place == len(self.vocabulary)] = 0
        known = self.vocabulary[place] == hashes
        edge = np.zeros(len(known), bool)
        firsts = found.bounds[:-1]
        edge[firsts[firsts < len(known)]] = True
        begins = np.flatnonzero(known & (edge | ~np.r_[False, known[:-1]]))
        last = np.r_[edge[1:], True] | ~np.r_[known[1:], False]
        ends = np.flatnonzero(known & last) + 1
        long = ends - begins >= self.shortest
        automaton, window = self.automaton, self.window
        texts = np.searchsorted(found.bounds, begins[long], side="right") - 1
        for text, lo, hi in zip(texts.tolist(), begins[long].tolist(), ends[long].tolist(), strict=True):
            run = place[lo:hi].tolist()
            best = 0
            for at, (state, length) in enumerate(automaton.stream(run), lo + 1):
                best = max(best, length)
                named = automaton.marked[state]
                if named and automaton.mark_length[named] > length:
                    named = automaton.marked[automaton.link[named]]
                while named:
                    hit[at - automaton.mark_length[named] : at] = True
                    items.setdefault(text, set()).update(automaton.names[named])
                    named = automaton.marked[automaton.link[named]]
            longest[text] = max(longest[text], best)


def _build(window: int):
    def build(batches: pa.Table) -> pa.Table:
        ids = [str(x) if x is not None else "null" for x in batches.column("item").to_pylist()]
        block = Block(ids, words.texts_of(batches.column("item_text")), window)
        return pa.table({"block": batches.column("block")[:1], "automaton": pa.array([pickle.dumps(block)], pa.large_binary())})

    return build


def _automata(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> list[str]:
    """Files with one automaton each, in the shared folder."""
    own = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("item_text"))
    total = own.agg(F.sum(F.size(F.split(shared.lower_ascii("item_text"), _WORD)))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    dealt = own.filter(F.col("item_text").isNotNull()).withColumn("block", F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)))
    folder = shared.new_folder(items.sparkSession, "automata")

    def save(tables: pa.Table) -> pa.Table:
        files, base = shared.filesystem(folder)
        files.create_dir(base, recursive=True)
        made = _build(window)(tables)
        name = f"block-{made['block'][0].as_py()}"
        with files.open_output_stream(f"{base}/{name}.part") as out:
            out.write(made["automaton"][0].as_py())
        files.move(f"{base}/{name}.part", f"{base}/{name}")
        return pa.table({"name": [f"{folder}/{name}"]})

    return sorted(row["name"] for row in dealt.groupBy("block").applyInArrow(save, "name string").distinct().collect())


_loaded: OrderedDict[str, Block] = OrderedDict()


def _load(name: str) -> Block:
    """The block of a file; the last one stays in memory."""
    if name not in _loaded:
        _loaded.clear()
        files, path = shared.filesystem(name)
        with files.open_input_stream(path) as source:
            _loaded[name] = pickle.loads(source.read())
    return _loaded[name]


def matches(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    keep: list[str] | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document: the columns in ``keep``, and what was found in its text.

    ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids as text, sorted), ``longest_match``,
    ``spans`` (hit stretches as code point offsets, end exclusive), ``coverage`` (hit words
    of all), ``clean_text`` (without the hit stretches; null if ``coverage`` exceeds
    ``max_coverage``; the text as it is where nothing is hit).
    """
    keep = [c for c in documents.columns if c != text_col] if keep is None else keep
    found = _scanned(documents, benchmark, text_col, item_id_col, item_text_col, window, max_coverage, keep, block_words)
    # A kept column with the name of a result gives way.
    kept = [F.col(f"row_.c{i}").alias(c) for i, c in enumerate(keep) if c not in _FIELDS]
    return found.select(*kept, *[F.col(f"found_.{c}").alias(c) for c in _FIELDS])


def _scanned(documents, benchmark, text_col, item_id_col, item_text_col, window, max_coverage, keep, block_words) -> DataFrame:
    """``row_``, a struct of the kept columns, and ``found_``, a struct of the results."""
    automata = _automata(benchmark, item_id_col, item_text_col, window, block_words)
    kinds = dict(documents.dtypes)
    inner = ", ".join(f"c{i}: {kinds[c]}" for i, c in enumerate(keep)) or "none: int"
    results = (
        "n_words: bigint, n_hit: bigint, n_items: bigint, items: array<string>, longest_match: bigint, "
        "spans: array<struct<start: bigint, end: bigint>>, coverage: double, clean_text: string"
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.texts_of(batch.column("text_"))
            for lo, hi in words.slices(texts):
                part = _scan_slice(texts.slice(lo, hi - lo), automata, max_coverage)
                made = pa.StructArray.from_arrays(part, names=list(_FIELDS))
                yield pa.RecordBatch.from_arrays([batch.column("row_").slice(lo, hi - lo), made], names=["row_", "found_"])

    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(0).alias("none"))
    read = documents.select(row.alias("row_"), F.col(f"`{text_col}`").cast("string").alias("text_"))
    return read.mapInArrow(scan, f"row_ struct<{inner}>, found_ struct<{results}>")


_FIELDS = ("n_words", "n_hit", "n_items", "items", "longest_match", "spans", "coverage", "clean_text")


def _scan_slice(texts: pa.Array, automata: list[str], max_coverage: float) -> list[pa.Array]:
    found = words.split(texts, words.WORD_CHARS)
    hashes = found.hashes()
    hit = np.zeros(len(hashes), bool)
    longest = np.zeros(len(texts), np.int64)
    items: dict[int, set[str]] = {}
    for name in automata:
        _load(name).find(found, hashes, hit, longest, items)
    n_words = found.counts()
    hits = np.r_[0, np.cumsum(hit)]
    n_hit = hits[found.bounds[1:]] - hits[found.bounds[:-1]]
    coverage = n_hit / np.maximum(n_words, 1)
    spans: list[list] = [[]] * len(texts)
    clean = None
    touched = np.flatnonzero(n_hit).tolist()
    if touched:
        clean = texts.to_pylist()
    for text in touched:
        lo, hi = found.bounds[text], found.bounds[text + 1]
        inside = np.r_[False, hit[lo:hi], False]
        first = np.flatnonzero(inside[1:] & ~inside[:-1]) + lo
        last = np.flatnonzero(~inside[1:] & inside[:-1]) - 1 + lo
        base = found.offsets[text]
        raw = clean[text].encode()
        pieces, own, at = [], [], 0
        for a, b in zip((found.starts[first] - base).tolist(), (found.ends[last] - base).tolist(), strict=True):
            pieces.append(raw[at:a])
            own.append((a, b))
            at = b
        pieces.append(raw[at:])
        spans[text] = [{"start": len(raw[:a].decode()), "end": len(raw[:b].decode())} for a, b in own]
        clean[text] = b"".join(pieces).decode() if coverage[text] <= max_coverage else None
    names = [sorted(items.get(i, ())) for i in range(len(texts))]
    return [
        pa.array(n_words, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in names], pa.int64()),
        pa.array(names, pa.list_(pa.string())),
        pa.array(longest),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        pa.array(coverage),
        pa.array(clean, pa.string()) if touched else texts,
    ]


def query(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` against all of ``benchmark``."""
    found = matches(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: leaked stretches are cut out; documents that are mostly benchmark go.

    Rows keep their columns and order of columns; ``n_chars`` follows the text.
    """
    benchmark = shared.table(spark, sf_dir, "benchmark")
    found = _scanned(docs, benchmark, "text", "item_id", "text", WINDOW, MAX_COVERAGE, docs.columns, BLOCK_WORDS)
    changed, text = F.col("found_.n_hit") > 0, F.col("found_.clean_text")
    own = {c: F.col(f"row_.c{i}") for i, c in enumerate(docs.columns)}
    values = {"text": F.when(changed, text).otherwise(own["text"])}
    if "n_chars" in own:
        values["n_chars"] = F.when(changed, F.char_length(text).cast(dict(docs.dtypes)["n_chars"])).otherwise(own["n_chars"])
    return found.filter(~changed | text.isNotNull()).select(*[values.get(c, own[c]).alias(c) for c in docs.columns])


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({_LOWER}, '{_WORD}'), [])"

ORACLE_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS.format("text")} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS.format("text")} as w from benchmark),
windows as (
  select distinct item, array_to_string(list_slice(w, i, i + least({WINDOW}, len(w)) - 1), ' ') as win, least({WINDOW}, len(w)) as size
  from b, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) as t(i) where len(w) > 0),
sizes as (select distinct size from windows),
places as (
  select r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as win
  from d, sizes, unnest(range(1, len(w) - size + 2)) as t(i)),
found as (select r, i, places.size, item from places join windows using (win)),
hits as (select r, count(distinct i + k) as n from found, unnest(range(0, size)) as t(k) group by r),
names as (select r, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct r, item from found) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hits.n, 0) as bigint) as n_hit,
  cast(coalesce(names.n, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(hits.n, 0) > 0 as contaminated
from d left join hits using (r) left join names using (r)
"""
