"""Quoted CSV files in many splits against whole files."""

import csv
import io
import random

import pytest

from textmill.sources import corpora, quoted


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def some_file(seed, ends="\n"):
    rng = random.Random(seed)
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=ends)
    w.writerow(["id", "text", "label"])
    for i in range(60):
        text = "".join(rng.choice(["a", "é", " ", ",", '"', "\n", "\n\n", "word", '""', "漢"]) for _ in range(rng.choice([0, 1, 5, 30, 400])))
        w.writerow([i, "x" + text if rng.random() < 0.9 else "", rng.choice(["HR", "NA", ""])])
        if rng.random() < 0.1:
            out.write(ends)
    return out.getvalue()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_file_in_many_tasks(spark, tmp_path, small_splits, seed):
    body = some_file(seed)
    (tmp_path / "one.csv").write_text(body, newline="")
    path = str(tmp_path / "one.csv")
    got = corpora.read_csv(spark, path)
    assert quoted._lines(spark, path, None).rdd.getNumPartitions() > 5
    assert rows(got) == rows(corpora.read_csv(spark, path, whole_files=True).select(got.columns))
    want = [(i, t or None) for i, t, _ in list(r for r in csv.reader(io.StringIO(body, newline="")) if r)[1:]]
    assert [(r["id"], r["text"]) for r in got.orderBy("row_id").collect()] == want
    assert [r["row_id"] for r in got.orderBy("row_id").collect()] == list(range(60))


def test_several_files_and_line_ends(spark, tmp_path, small_splits):
    for k in range(4):
        (tmp_path / f"part-{k}.csv").write_text(some_file(10 + k), newline="")
    got = corpora.read_csv(spark, str(tmp_path))
    assert rows(got) == rows(corpora.read_csv(spark, str(tmp_path), whole_files=True).select(got.columns))
    assert corpora.read_csv_directory(spark, str(tmp_path)).groupBy("source_file").count().count() == 4


def test_carriage_returns_end_records(spark, tmp_path, small_splits):
    path = tmp_path / "dos.csv"
    path.write_text('id,text\r\n1,"a\nb"\r\n\r\n2,c\r\n', newline="")
    assert [tuple(r) for r in corpora.read_csv(spark, str(path)).orderBy("row_id").collect()] == [("1", "a\nb", 0), ("2", "c", 1)]


@pytest.mark.parametrize("body", ["id,text\n", 'id,text', 'id,text\n1,"ends inside\n'])
def test_short_files(spark, tmp_path, body):
    path = tmp_path / "short.csv"
    path.write_text(body)
    assert corpora.read_csv(spark, str(path)).count() == (1 if "ends" in body else 0)


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    path = tmp_path / "long.csv"
    path.write_text('id,text\n1,"' + "long line\n" * 300 + '"\n2,"next"\n3,"' + "x" * 2000 + '"\n')
    got = corpora.read_csv(spark, str(path)).orderBy("row_id").collect()
    assert [r["text"] for r in got] == ["long line\n" * 300, "next", "x" * 2000]
