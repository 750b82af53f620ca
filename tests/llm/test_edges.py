"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabgauge.llm import bpe, decontaminate, language_model, near_duplicates, quality, secret_scan, shared, token_output, toxicity, url_lists, warc
from tabgauge.llm.token_output import vocabulary_path

LONG = " ".join(f"word{i % 977} idiot{i % 13}," for i in range(30_000))
COPY = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (None, None, "en"),
    (None, COPY, "en"),
    (1, "", None),
    (2, "word", "en"),
    (2, "word", "en"),
    (3, None, "de"),
    (4, LONG, "en"),
    (5, COPY.upper(), None),
    (6, "  \n\t ", "fr"),
    (7, "漢字 Ñandú ﬁ   x", "es"),
    (8, 'TOKEN: "abcdef0123" <|endoftext|>', "en"),
]
EXTRA = {"n_words": 7, "score": "x", "spans": 1, "text_": "t", "key": "k", "row_": 2, "bucket": 3, "items": "i", "n_tokens": "n", "id_": "q"}


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    made = made.withColumn("source", F.lit("s")).withColumn("n_chars", F.char_length("text").cast("bigint"))
    for name, value in EXTRA.items():
        made = made.withColumn(name, F.lit(value))
    return made


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 1, 1), (4, 1, 1), (4, 0, 0), (2, None, None), (7, 1, 0), (1, 0, 0)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit(9))


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(None, COPY), (1, None), (2, ""), (3, "word"), (3, "word"), (4, "!!")]
    return spark.createDataFrame(rows, "item_id bigint, text string").withColumn("block", F.lit(5))


def empty(frame):
    return frame.filter("false")


def test_near_duplicates(docs):
    found = near_duplicates.classes(docs).collect()
    assert len(found) == len(ROWS)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[2]["n_links"] == 1 and by_id[5]["n_links"] == 1  # the repeated row; the text under a null id
    assert sorted(r["class_id"] for r in found if r["doc_id"] is None and r["n_links"]) == [5]
    assert by_id[1]["class_id"] == 1 and by_id[1]["n_links"] == 0
    assert near_duplicates.classes(empty(docs)).count() == 0


def test_near_duplicate_stage(spark, docs):
    kept = near_duplicates.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    found = kept.select("doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [r["text"] for r in found if r["doc_id"] is None] == [None]
    assert near_duplicates.keep_one(spark, empty(docs), "").count() == 0


def test_near_duplicate_stage_keeps_unrelated_texts_under_null_and_repeated_ids(spark):
    alone = [f"{name} stands alone among all of the texts here" for name in ("alpha", "beta", "gamma", "delta", "omega")]
    near = [" ".join(f"w{i}" if i != k else "x" for i in range(80)) for k in (100, 0, 79)]
    rows = [(None, alone[0]), (None, alone[1]), (7, alone[2]), (7, alone[3]), (7, near[0]), (8, near[1]), (None, near[2]), (None, alone[4]), (None, alone[4])]
    kept = near_duplicates.keep_one(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([*(("None", alone[i]) for i in (0, 1, 4)), ("7", alone[2]), ("7", alone[3]), ("7", near[0])])


def test_decontamination(docs, benchmark):
    found = decontaminate.matches(docs, benchmark)
    assert found.columns.count("n_words") == 1
    rows = {(r["doc_id"], r["n_words"]): r for r in found.collect()}
    assert rows[None, 12]["items"] == ["null"] and rows[5, 12]["n_hit"] == 12 and rows[5, 12]["clean_text"] is None
    assert rows[2, 1]["items"] == ["3"] and rows[3, 0]["n_hit"] == 0
    assert found.count() == len(ROWS)
    assert decontaminate.matches(docs, empty(benchmark)).filter("n_hit > 0").count() == 0
    assert decontaminate.matches(empty(docs), benchmark).count() == 0


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path(bpe.VOCABULARY))
    found = bpe.round_trip(docs, vocabulary_path(bpe.VOCABULARY)).select("doc_id", "ids", "decoded").collect()
    given = sorted((str(i), t or "") for i, t, _ in ROWS)
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in found) == given
    for r in found:
        assert r["ids"] == library.encode(r["decoded"], add_special_tokens=False).ids
    assert bpe.digests(empty(docs), vocabulary_path(bpe.VOCABULARY)).count() == 0


def test_token_output(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/ids"
    token_output.write(docs, folder, vocabulary_path(token_output.VOCABULARY))
    found = token_output.positions(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted((i for i, *_ in ROWS), key=lambda i: -1 if i is None else i)
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    assert found[2]["ids_crc32"] == zlib.crc32((1).to_bytes(4, "little"))
    assert sorted(r["doc_id"] for r in token_output.read(spark, folder, [2, 7]).collect()) == [2, 2, 7]
    token_output.write(empty(docs), f"{folder}-none", vocabulary_path(token_output.VOCABULARY))
    assert token_output.positions(spark, f"{folder}-none").count() == 0 if list((tmp_path / "ids-none").glob("*.orc")) else True


def test_language_model(docs):
    spec = language_model.train(docs)
    found = language_model.score(docs, spec, docs.columns)
    assert found.columns.count("score") == 1 and found.count() == len(ROWS)
    assert found.filter("score > 0 or base_score > 0 or n_known <> n_tokens").count() == 0
    none = language_model.train(empty(docs))
    assert {r["score"] for r in language_model.score(docs, none, ["doc_id"]).collect()} == {0.0}
    assert language_model.score(empty(docs), spec, ["doc_id"]).count() == 0


def test_quality(docs, labels):
    for weight in (quality.weights(docs, labels), quality.weights(docs, empty(labels)), quality.weights(empty(docs), labels)):
        found = quality.rate(docs, weight)
        assert found.columns.count("n_words") == 1
        rows = {r["doc_id"]: r for r in found.collect()}
        assert rows[3]["n_words"] == 0 and not rows[3]["kept"] and rows[4]["n_words"] == 60_000
    assert quality.rate(empty(docs), weight).count() == 0


def test_own_columns_with_inner_names_stay(spark, docs, labels, pages):
    own = {"__text": "a", "__words": 1, "__row": "r", "c0": 2, "__id": "i", "none": 0}
    marked = docs.select("doc_id", "text", *[F.lit(v).alias(c) for c, v in own.items()])
    rated = quality.rate(marked, quality.weights(marked, labels))
    assert rated.columns[: len(marked.columns)] == marked.columns
    assert {tuple(r[c] for c in own) for r in rated.collect()} == {tuple(own.values())}
    seen = {"__url": 3, "__at": "t", "__n": 4, "__best": "b", "c1": 5}
    captures = pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_700_000_000)).alias("fetched_at"), *[F.lit(v).alias(c) for c, v in seen.items()])
    judged = url_lists.evaluate(captures, url_lists.derived_changes(pages))
    assert judged.columns[: len(captures.columns)] == captures.columns
    assert judged.count() == pages.count() and {tuple(r[c] for c in seen) for r in judged.collect()} == {tuple(seen.values())}


def test_work_is_dealt_by_its_size_not_by_the_keys(spark, pages, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(4000).selectExpr("id as page_id", "concat('http://h', id % 90, '.example.com/p/', id) as url", "repeat(cast(id as string), 400) as html")
    parts = warc.write(warc.captures(many), f"file://{tmp_path}/many")
    wanted = many.select(warc.url_key(F.col("url")).alias("url_key"), "page_id")
    found = warc.look_up(wanted, parts)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == cores
    assert found.count() == 4000


def test_a_cluster_needs_the_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session)


def test_secret_scan(spark, docs):
    found = secret_scan.scan(docs, secret_scan.train(docs), docs.columns)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == len({i for i, *_ in ROWS}) and found.count() == len(ROWS)
    assert [(s["kind"], s["start"], s["end"]) for s in rows[8]["__spans"]][0] == ("assign", 0, 18)
    out = secret_scan.redact(spark, docs, "")
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert out.filter("doc_id = 8").first()["text"].startswith('TOKEN: "[SECRET]"')
    assert secret_scan.redact(spark, empty(docs), "").count() == 0


def test_toxicity(docs, labels):
    for some in (labels, empty(labels)):
        model = toxicity.train(docs, some)
        rows = toxicity.score(docs, model, docs.columns).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["__score"] <= 1 for r in rows)
    assert toxicity.score(empty(docs), model, ["doc_id"]).count() == 0


@pytest.fixture
def pages(spark):
    big = "<p>" + "x" * 2000
    rows = [
        (1, "http://a.example.com/x/y?q#f", big),
        (2, "https://www.example.com/", big),
        (2, "https://www.example.com/", big),
        (None, None, big),
        (3, "", None),
        (4, "http://a.example.com/x/z\r\nq", ""),
        (5, "not a url", "short"),
        (6, "http://b.example.com/", "short"),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("largest", F.lit(2))


def test_warc(spark, pages, tmp_path):
    parts = warc.write(warc.captures(pages), f"file://{tmp_path}/warc")
    wanted = pages.select(warc.url_key(F.col("url")).alias("url_key"), "page_id")
    found = warc.look_up(wanted, parts).collect()
    assert len(found) == pages.count()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in found)
    assert kinds == [("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("6", "response", None), ("None", "revisit", 2)]
    assert {r["payload_digest"] for r in found if r["page_id"] in (5, 6)} == {hashlib.sha1(b"short").hexdigest()}
    none = warc.write(warc.captures(empty(pages)), f"file://{tmp_path}/none")
    assert warc.look_up(empty(wanted), none).count() == 0 and warc.look_up(wanted, none).count() == 0


def test_url_lists(spark, pages):
    captures = pages.withColumn("fetched_at", F.when(F.col("page_id").isNotNull(), F.timestamp_seconds(F.lit(1_700_000_000)))).withColumn("blocked", F.lit("?")).withColumn("list", F.lit(1))
    changes = spark.createDataFrame(
        [
            ("block", "domain", "example.com", "add", 1_600_000_000),
            ("allow", "prefix", "a.example.com/x/", "add", 1_650_000_000),
            ("block", "domain", "example.com", "remove", 1_690_000_000),
            ("block", "domain", "example.com", "add", 1_690_000_000),
            ("block", "url", "www.example.com/", "add", 1_700_000_001),
            (None, "domain", "com", "add", 0),
            ("block", "domain", "com", None, 0),
        ],
        "list string, scope string, pattern string, action string, s bigint",
    ).select("list", "scope", "pattern", "action", F.timestamp_seconds("s").alias("at"))
    found = url_lists.evaluate(captures, changes)
    assert found.columns.count("blocked") == 1
    rows = {r["page_id"]: (r["blocked"], r["decided_scope"], r["n_active"]) for r in found.collect()}
    assert rows == {1: (False, "prefix", 2), 2: (True, "domain", 1), None: (False, None, 0), 3: (False, None, 0), 4: (False, "prefix", 2), 5: (False, None, 0), 6: (True, "domain", 1)}
    assert found.count() == captures.count()
    assert url_lists.evaluate(captures, changes.filter("false")).filter("blocked").count() == 0
    assert url_lists.evaluate(empty(captures), changes).count() == 0


def test_pipeline_stages_take_odd_and_empty_tables(spark, docs, labels, benchmark, tmp_path):
    for some, rows in (("some", 8), ("none", 0)):
        sf_dir = f"file://{tmp_path}/{some}"
        only = (lambda f: f) if some == "some" else empty
        for name, frame in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
            only(frame).write.parquet(f"{sf_dir}/{name}.parquet")
        at = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, sf_dir)
            assert out.columns == at.columns, name
            at = shared.written(out, name)
        done = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir)
        assert done.count() == at.count() <= rows
        assert corpus_pipeline.run(spark, sf_dir).count() == done.count()


@pytest.mark.parametrize("stage", [toxicity.keep_clean, secret_scan.redact])
def test_stages_carry_columns_named_like_results(spark, stage, tmp_path):
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i, "you idiot, idiot!" if i % 2 else "password = abcdef123456 and prose", 1.5, "mine", "own") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __score double, __spans string, __clean string")
    found = stage(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    kept = found.collect()
    assert kept and {(r["__score"], r["__spans"], r["__clean"]) for r in kept} == {(1.5, "mine", "own")}


def test_a_task_of_another_operator_gives_back_what_toxicity_keeps():
    first = toxicity._features((b"word",))
    assert toxicity._features((b"word",)) is first
    assert list(near_duplicates._measure(4)(iter(()))) == []
    assert toxicity._features((b"word",)) is not first
