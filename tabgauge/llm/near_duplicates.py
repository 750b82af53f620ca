"""N-gram Jaccard join: MinHash banding, then exact verification.

Documents are sets of five-word shingles; two are linked if their sets have a Jaccard
similarity of ``THRESHOLD`` or more. Equal word sequences count as one text from the start.

**Bands.** Every text has a label of ``DEPTH`` MinHash values in each of ``TREES`` trees. Texts
with one prefix of a label are candidates. The prefix has one length for all data: full
depth, shortened until two texts at the threshold meet in some tree with probability
``TARGET_RECALL``. That is banding; no trie is built and no match shortens a prefix.

**Candidates.** A prefix with several texts is one group of rows, sorted and streamed. Groups
above ``GROUP`` texts are dealt into pairs of blocks. Within a group a text is compared
by its byte-wide sketch with those not yet reached, which finds the same connections as
all pairs do; only connections leave the task, never pairs. The sketch misses a pair at the
threshold with 5.0e-7, the bands with 4.7e-8, so both together with 5.5e-7 at most.

**Verification.** Connected candidates form families. Each text of a family travels with its
exact shingle set, once for small families, once per block for large ones; tasks count
shared shingles by matrix products and give each text's number of links and the links
that connect it. No pair is ever a row. Links make the classes.

Shingles are 64-bit hashes of whole words' hashes; sets are exact but for hash collisions.

Defined results: a class id is the smallest document id of the class. Null texts and texts
without words have no shingles and link to nothing. Texts of one to four words have one
shingle, all their words. Repeated rows are copies of one another: each keeps its row, and
counts as a link of the others. A null id never is the smallest; a class of null ids only
has a null class id. So classes may bear one class id where ids are null or repeated; the
pipeline stage tells them apart all the same. Null and repeated ids cost no more than others,
since a text is found again by its id and its hash. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 5
TARGET_RECALL = 0.9999999
#: Most texts that a group of candidates is compared in at once.
GROUP = 4096
#: Most texts, and shingles, about, of one side in a verification.
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 1_000_000
#: Standard deviations of a sketch's estimate that a candidate may fall short of the threshold.
SKETCH_SLACK = 5.0


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """Shorten the prefix until texts at the threshold meet with the wanted probability."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < target:
        k -= 1
    return k


_XOR, _ODD = words.seeded(TREES * DEPTH, 21), words.seeded(TREES * DEPTH, 22) | np.uint64(1)
_PLACE = words.seeded(SHINGLE, 23) | np.uint64(1)
_SEED = words.seeded(TREES + 2, 24)


def shingles(found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a slice of texts, repeats included, and where each text's begin."""
    h = found.hashes()
    n = found.counts()
    total = len(h)
    text = np.repeat(np.arange(len(n)), n)
    sums = np.zeros(total, np.uint64)
    left = np.repeat(found.bounds[1:], n) - np.arange(total)  # words from here to the end of the text
    for i in range(SHINGLE):
        inside = np.flatnonzero(left > i)
        sums[inside] += words.mix(h[inside + i] * _PLACE[i])
    # A text of fewer words is one shingle, which starts at its first word.
    start = (left >= SHINGLE) | ((n[text] < SHINGLE) & (left == n[text]))
    bounds = np.r_[0, np.cumsum(start)][found.bounds]
    return words.mix(sums[start]), bounds


def _text_keys(found: words.Words) -> list[bytes]:
    """128 bits of each text's sequence of words."""
    h, n = found.hashes(), found.counts()
    at = np.arange(len(h), dtype=np.uint64) - np.repeat(found.bounds[:-1], n).astype(np.uint64)
    parts = []
    for seed in _SEED[:2]:
        sums = np.r_[np.uint64(0), np.cumsum(words.mix(h ^ words.mix(at + seed)))]
        parts.append(words.mix(sums[found.bounds[1:]] - sums[found.bounds[:-1]] + n.astype(np.uint64)))
    return [a.tobytes() for a in np.stack(parts, 1)]


def _signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values per text with shingles."""
    out = np.empty((len(bounds) - 1, len(_XOR)), np.uint64)
    for k in range(len(_XOR)):
        out[:, k] = np.minimum.reduceat((values ^ _XOR[k]) * _ODD[k], bounds[:-1])
    return out


def _measure(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release()
        for batch in batches:
            texts = words.texts_of(batch.column("text_"))
            for lo, hi in words.slices(texts):
                found = words.split(texts.slice(lo, hi - lo), words.NOT_SPACE)
                values, bounds = shingles(found)
                some = np.flatnonzero(np.diff(bounds))
                keys = _text_keys(found)
                prefix = np.zeros((hi - lo, TREES), np.int64)
                sketch = np.zeros((hi - lo, len(_XOR)), np.uint8)
                if len(some):
                    signature = _signatures(values, np.r_[bounds[some], len(values)])
                    sketch[some] = (signature >> np.uint64(56)).astype(np.uint8) ^ (signature & np.uint64(255)).astype(np.uint8)
                    by_tree = signature.reshape(len(some), TREES, DEPTH)
                    mixed = np.broadcast_to(_SEED[2:], (len(some), TREES)).copy()
                    for d in range(length):
                        mixed = words.mix(mixed ^ by_tree[:, :, d])
                    prefix[some] = mixed.view(np.int64)
                full = np.diff(bounds) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id_").slice(lo, hi - lo),
                        batch.column("hash_").slice(lo, hi - lo),
                        pa.array([k if f else None for k, f in zip(keys, full, strict=True)], pa.binary()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.FixedSizeListArray.from_arrays(pa.array(prefix.ravel()), TREES).cast(pa.list_(pa.int64())),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    names=["id_", "hash_", "key", "n", "prefix", "sketch"],
                )

    return run


def grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal values in ``by``, of rows that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for c in by:
            values = batch.column(c).to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in by):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _connect(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Connections of a graph on ``n`` nodes; ``near`` tells which of some nodes a node is linked to."""
    out, rest = [], np.arange(n)
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        at = queue.pop()
        if len(rest):
            hit = near(at, rest)
            out += [(at, int(x)) for x in rest[hit]]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return out


def _candidates(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["bucket", "first", "second"]):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            keys = group.column("key").to_pylist()
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(keys), -1)
            found = _connect(len(keys), lambda i, rest, s=sketch: (s[rest] == s[i]).sum(1) >= least)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in found], pa.binary()), pa.array([keys[b] for _, b in found], pa.binary())], names=["a", "b"])

    return run


def _dealt(rows: DataFrame, group: str, blocks) -> DataFrame:
    """Rows once for each pair of blocks that their own block belongs to: ``first, second, block``."""
    own = F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks_")).cast("int")
    numbered = rows.withColumn("blocks_", blocks).withColumn("block", own)
    paired = numbered.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)))
    return paired.withColumn("first", F.least("block", "other_")).withColumn("second", F.greatest("block", "other_")).drop("blocks_", "other_")


def _verify(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["family", "first", "second"]):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            keys = group.column("key").to_pylist()
            copies = group.column("copies").to_numpy()
            cross = group.column("first")[0].as_py() != group.column("second")[0].as_py()
            block = group.column("block").to_numpy() if cross else np.zeros(len(keys), int)
            linked = links([np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()], threshold)
            if cross:
                linked &= block[:, None] != block[None, :]
            count = linked @ copies
            some = np.flatnonzero(count)
            if not len(some):
                continue
            joined = _connect(len(keys), lambda i, rest, m=linked: m[i, rest])
            # One row per text with links, and one per connection.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i] for i in some] + [keys[a] for a, _ in joined], pa.binary()),
                    pa.array([None] * len(some) + [keys[b] for _, b in joined], pa.binary()),
                    pa.array([*count[some].tolist(), *([0] * len(joined))], pa.int64()),
                ],
                names=["a", "b", "links"],
            )

    return run


def links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets have the wanted Jaccard similarity; exact, by counts of shared members."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    member = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, column, times = np.unique(member, return_inverse=True, return_counts=True)
    shared_by = times > 1
    number = np.cumsum(shared_by) - 1
    use = shared_by[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    step = max(64, (4 << 20) // n)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((n, min(step, int(column[b - 1]) + 1 - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    shared_count = np.rint(both).astype(np.int64)
    union = size[:, None] + size[None, :] - shared_count
    # Five times the threshold is a whole number for 0.8; compare without rounding.
    out = shared_count >= np.ceil(threshold * union - 1e-9)
    out &= shared_count > 0
    np.fill_diagonal(out, False)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared.release()
    last = None  # rows of one text lie together; the first will do
    for batch in batches:
        texts = words.texts_of(batch.column("text_"))
        for lo, hi in words.slices(texts):
            found = words.split(texts.slice(lo, hi - lo), words.NOT_SPACE)
            values, bounds = shingles(found)
            own = [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            keys = _text_keys(found)
            want = batch.column("key").slice(lo, hi - lo).to_pylist()
            keep = []
            for i, (k, w) in enumerate(zip(keys, want, strict=True)):
                if k == w and k != last:
                    keep.append(i)
                    last = k
            rows = batch.slice(lo, hi - lo).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(c) for c in ("key", "family", "copies", "texts_", "shingles_")] + [pa.array([own[i].tobytes() for i in keep], pa.binary())],
                names=["key", "family", "copies", "texts_", "shingles_", "set"],
            )


def resolve(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows and texts. Rows: ``id_, key`` (null without shingles). Texts: ``key, component, class_id, n_links, copies, own_id``.

    ``own_id`` is the smallest id of a text's rows. ``component`` tells classes apart, which
    ``class_id`` does not where ids are null or repeated; a text without links is its own.
    """
    text = F.col(f"`{text_col}`").cast("string")
    read = documents.select(F.col(f"`{id_col}`").alias("id_"), F.xxhash64(text).alias("hash_"), text.alias("text_"))
    kind = dict(read.dtypes)["id_"]
    schema = f"id_ {kind}, hash_ bigint, key binary, n bigint, prefix array<bigint>, sketch binary"
    measured = shared.written(read.mapInArrow(_measure(prefix_length()), schema), "signatures")
    rows = measured.select("id_", "key")

    # Copies of a text have one row from here on; they were counted per task before they met.
    first_row = F.min(F.struct(F.col("id_").isNull(), "id_", "hash_"))
    texts = shared.written(
        measured.filter("key is not null")
        .groupBy("key")
        .agg(F.count("*").alias("copies"), first_row["id_"].alias("own_id"), first_row["hash_"].alias("own_hash"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")),
        "texts",
    )
    # A bucket belongs to one tree, so the largest has a thirty-second of these rows at most.
    bucketed = texts.select("key", F.explode("prefix").alias("bucket"))
    # Counted per task before rows meet; a very common bucket is then joined, which Spark can split.
    size = bucketed.groupBy("bucket").agg(F.count("*").alias("texts_")).filter("texts_ > 1")
    met = shared.written(bucketed.join(size, "bucket").select("bucket", "key", "texts_"), "buckets")
    sketches = texts.join(met.select("key").distinct(), "key", "left_semi").select("key", "sketch")
    least = int(np.floor(TREES * DEPTH * max(0.0, THRESHOLD - SKETCH_SLACK * (THRESHOLD * (1 - THRESHOLD) / (TREES * DEPTH)) ** 0.5)))
    split = _dealt(met, "bucket", F.ceil(F.col("texts_") / GROUP).cast("int")).join(sketches, "key")
    order = ("bucket", "first", "second")
    pairs = split.select(*order, "key", "sketch").repartition(*order).sortWithinPartitions(*order, "key").mapInArrow(_candidates(least), "a binary, b binary")
    family = components(pairs.distinct())

    plain = texts.select("key", "copies", "own_id", "own_hash", "n")
    member = family.select(F.col("node").alias("key"), F.col("component").alias("family")).join(plain, "key")
    size = member.groupBy("family").agg(F.count("*").alias("texts_"), F.sum("n").alias("shingles_"))
    wanted = shared.written(member.join(size, "family"), "families")
    # The text of one row of each: found by id and hash, so that null and repeated ids meet their
    # own text only, and checked by key in the task. The texts meet by a sort-merge join at any
    # size, for what is wanted of them grows with the corpus.
    own_row = F.col("id_").eqNullSafe(F.col("own_id")) & (F.col("hash_") == F.col("own_hash"))
    source = read.hint("merge").join(wanted, own_row).select("key", "family", "copies", "texts_", "shingles_", "text_")
    own = source.mapInArrow(_sets, "key binary, family binary, copies bigint, texts_ bigint, shingles_ bigint, set binary")
    own = shared.written(own.dropDuplicates(["key"]), "sets")
    blocks = F.greatest(F.ceil(F.col("texts_") / BLOCK_TEXTS), F.ceil(F.col("shingles_") / BLOCK_SHINGLES)).cast("int")
    order = ("family", "first", "second")
    checked = _dealt(own, "family", F.least(blocks, F.col("texts_").cast("int"))).select(*order, "block", "key", "copies", "set")
    found = shared.written(
        checked.repartition(*order).sortWithinPartitions(*order, "key").mapInArrow(_verify(THRESHOLD), "a binary, b binary, links bigint"), "links"
    )
    counts = found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    classes = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    joined = shared.written(plain.join(classes, "key", "left").join(counts, "key", "left"), "joined")
    least_id = joined.filter("component is not null").groupBy("component").agg(F.min("own_id").alias("class_id"))
    done = joined.join(shared.written(least_id, "class-ids"), "component", "left").select(
        "key",
        F.coalesce("component", "key").alias("component"),
        F.when(F.col("component").isNull(), F.col("own_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "copies",
        "own_id",
    )
    return rows, shared.written(done, "classes")


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of the documents: its id, ``class_id`` and ``n_links``."""
    rows, texts = resolve(documents, id_col, text_col)
    alone = rows.filter("key is null").select(F.col("id_").alias(id_col), F.col("id_").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    linked = rows.filter("key is not null").join(texts, "key").select(F.col("id_").alias(id_col), "class_id", "n_links")
    return linked.union(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return classes(shared.table(spark, sf_dir, "documents"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared.release()
    for batch in batches:
        texts = words.texts_of(batch.column("text_"))
        for lo, hi in words.slices(texts):
            found = words.split(texts.slice(lo, hi - lo), words.NOT_SPACE)
            some = found.counts() > 0
            keys = pa.array([k if s else None for k, s in zip(_text_keys(found), some, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row_").slice(lo, hi - lo), keys], names=["row_", "key"])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the row with the smallest id stays; rows without shingles all do."""
    rows, texts = resolve(docs)
    # The text of a class that bears its smallest id; of several, the first by key.
    best = texts.groupBy("component").agg(F.min(F.struct(F.col("own_id").isNull(), "own_id", "key")).alias("best"))
    again = rows.filter("key is not null").groupBy("key", "id_").agg(F.count("*").alias("n_own")).filter("n_own > 1")
    found = texts.join(best.select(F.col("best.key").alias("key")), "key", "left_semi").select("key", "own_id").alias("t")
    repeated = (F.col("t.key") == F.col("r.key")) & F.col("t.own_id").eqNullSafe(F.col("r.id_"))
    chosen = shared.written(found.join(again.alias("r"), repeated, "left").select("t.key", "t.own_id", F.coalesce("r.n_own", F.lit(1)).alias("n_own")), "chosen")
    inner = ", ".join(f"c{i}: {t}" for i, (_, t) in enumerate(docs.dtypes))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    own = docs.select(row.alias("row_"), F.col("text").cast("string").alias("text_")).mapInArrow(_keyed, f"row_ struct<{inner}>, key binary")
    place = docs.columns.index("doc_id")
    own = own.withColumn("id_", F.col(f"row_.c{place}"))
    # By key and id, so that the copies of a common text do not all meet.
    first_row = (F.col("o.key") == F.col("c.key")) & F.col("o.id_").eqNullSafe(F.col("c.own_id"))
    kept = own.alias("o").hint("merge").join(chosen.alias("c"), first_row).select("o.key", "o.row_", "c.n_own")
    # Rows that repeat both id and text: one of them. Others need no shuffle for it.
    out = kept.filter("n_own = 1").union(kept.filter("n_own > 1").dropDuplicates(["key"])).select("row_").union(own.filter("key is null").select("row_"))
    return out.select(*[F.col(f"row_.c{i}").alias(c) for i, c in enumerate(docs.columns)])


# Link sizes: shared shingles of the union, 0.8 or more, as whole numbers.
ORACLE_SQL = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + {SHINGLE} - 1), ' ') as g
  from d, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1)) as t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
linked as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 5 * m >= 4 * (x.n + y.n - m)),
reach as (select doc_id as node, doc_id as near from documents union select node, b from reach join linked on near = a),
class as (select node, min(near) as class_id from reach group by node),
degree as (select a, count(*) as n from linked group by a)
select doc_id, class_id, cast(coalesce(degree.n, 0) as bigint) as n_links
from documents join class on node = doc_id left join degree on a = doc_id
"""
