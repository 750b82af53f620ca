from __future__ import annotations

import csv
import random

import tabgauge as tg
from tabgauge.functions.tasks import tasks_of
from tabgauge.sources import quoted


def test_csv_quotes_breaks_and_dates(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text('id,text,day\n1,"say ""hi"", ok",2024-01-02\n2,"two\nlines",2024-01-03\n3,plain,2024-01-04\n')
    found = tg.read_csv(spark, str(file), multi_line=True, dates_as_text=True)
    assert dict(found.dtypes) == {"id": "int", "text": "string", "day": "string"}
    rows = {r["id"]: (r["text"], r["day"]) for r in found.collect()}
    assert rows == {1: ('say "hi", ok', "2024-01-02"), 2: ("two\nlines", "2024-01-03"), 3: ("plain", "2024-01-04")}
    assert dict(tg.read_csv(spark, str(file), multi_line=True).dtypes)["day"] == "date"


def test_quoted_breaks_across_splits(spark, tmp_path):
    random.seed(2)
    texts = ["plain", "two\nlines", 'say "hi",\nthen go', "", "é\r\nü", "\n\n", '""', "x" * 300, "a,b\n" * 40]
    for k in range(2):
        with open(tmp_path / f"t{k}.csv", "w", newline="") as file:
            out = csv.writer(file, lineterminator="\r\n" if k else "\n")
            out.writerow(["id", "text", "day", "number"])
            out.writerows((1000 * k + i, random.choice(texts), f"2024-01-{i % 28 + 1:02}", i / 4) for i in range(700))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        whole = tg.read_csv(spark, str(tmp_path), multi_line=True)
        found = tg.read_csv(spark, str(tmp_path), multi_line=True, split_files=True)
        assert found.dtypes == whole.dtypes
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
        assert tasks_of(found) > 20 > tasks_of(whole)
        assert quoted._inside(quoted._lines(spark, str(tmp_path)))
        given = tg.read_csv(spark, str(tmp_path), "id long, text string, day string, number double", multi_line=True, split_files=True)
        assert given.filter("id = 1005").first()["day"] == "2024-01-06"
        text = tg.read_csv(spark, str(tmp_path), multi_line=True, split_files=True, dates_as_text=True)
        assert dict(text.dtypes)["day"] == "string"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_record_over_many_splits(spark, tmp_path):
    long = "\n".join(f"line {i}, with more" for i in range(3000))
    (tmp_path / "t.csv").write_text(f'id,text\n1,"{long}"\n2,short\n3,"end\n"')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = tg.read_csv(spark, str(tmp_path / "t.csv"), multi_line=True, split_files=True)
        assert {r["id"]: r["text"] for r in found.collect()} == {1: long, 2: "short", 3: "end\n"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
