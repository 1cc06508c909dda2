import pytest

from textmill.config import DatasetConfig
from textmill.sources import corpora

FIRST = 'ID,Resume_str,Resume_html,Category\n1,"Line one\nline ""two""",<p>,HR\n2,plain,<p>,CHEF\n3,plain,<p>,HR\n4,NA,<p>,HR\n'
SECOND = "Category,Resume\nHR,second a\nHR,second a\nChef,plain\nSales,\n"
THIRD = "Category,Resume\nJava_Developer,third a\n"


@pytest.fixture
def config(tmp_path):
    for name, body in (("a.csv", FIRST), ("b.csv", SECOND), ("c.csv", THIRD)):
        (tmp_path / name).write_text(body)
    return DatasetConfig(*(str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")))


def pairs(df):
    return sorted((r["text"], r["label"]) for r in df.collect())


def test_first(spark, config):
    assert pairs(corpora.load_first(spark, config=config)) == [('Line one\nline "two"', "HR"), ("plain", "CHEF")]


def test_second_and_third(spark, config):
    assert pairs(corpora.load_second(spark, config=config)) == [("plain", "Chef"), ("second a", "HR")]
    assert pairs(corpora.load_third(spark, config=config)) == [("third a", "Java_Developer")]


def test_combined_keeps_the_first_source(spark, config):
    both = corpora.load_dataset(spark, "both", config)
    assert ("plain", "CHEF") in pairs(both) and both.count() == 3
    assert corpora.load_dataset(spark, "all", config).count() == 4
    assert corpora.load_dataset(spark, "corpus", config).count() == 1
    assert corpora.load_dataset(spark, "clean", config).count() == 0  # every label is rare


def test_errors(spark, config, tmp_path):
    with pytest.raises(ValueError, match="Invalid dataset mode"):
        corpora.load_dataset(spark, "everything", config)
    with pytest.raises(FileNotFoundError):
        corpora.load_first(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError, match="ingest_pairs"):
        corpora.load_third(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="missing required columns"):
        corpora.load_third(spark, config.resume_csv)
    with pytest.raises(ValueError, match="No datasets"):
        corpora.load_combined(spark, False, False)


def test_absent_files_are_skipped(spark, config, tmp_path):
    partial = DatasetConfig(config.resume_csv, str(tmp_path / "none.csv"), config.corpus_csv)
    assert corpora.load_combined(spark, config=partial).count() == 2


def test_csv_directory(spark, config, tmp_path):
    assert corpora.list_csv_files(spark, str(tmp_path)).count() == 3
    only = tmp_path / "same"
    only.mkdir()
    (only / "x.csv").write_text(SECOND)
    files = {r["source_file"] for r in corpora.read_csv_directory(spark, str(only)).collect()}
    assert files == {"x.csv"}


def test_pairs_of_files(spark, tmp_path):
    for stem, text, lab in (("00001", "<b>Hello</b>", "Java_Developer\nother"), ("00002", "Bye", "hr"),
                            ("00003", "Bye", "Chef"), ("00004", "lonely", None)):
        (tmp_path / f"{stem}.txt").write_text(text)
        if lab is not None:
            (tmp_path / f"{stem}.lab").write_text(lab)
    got = sorted(tuple(r) for r in corpora.ingest_pairs(spark, str(tmp_path)).collect())
    assert got == [("00001", " Hello ", "Java Developer"), ("00002", "Bye", "HR")]



def test_row_ids_follow_path_and_position(spark, tmp_path):
    """However long the files are, and however they are packed."""
    for name, rows in (("a", ["one"]), ("b", [f"row {k}" for k in range(400)]), ("c", ["last", "very last"])):
        (tmp_path / f"{name}.csv").write_text("Category,Resume\n" + "".join(f"HR,{r}\n" for r in rows))
    got = corpora.read_csv(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["Resume"] for r in got] == ["one", *[f"row {k}" for k in range(400)], "last", "very last"]
    assert got[0].asDict().keys() == {"Category", "Resume", "row_id"}


def test_input_partitions_are_a_setting(spark, tables):
    from textmill.sources.tables import read_corpus
    was = spark.conf.get("textmill.input.partitions")
    try:
        spark.conf.set("textmill.input.partitions", "7")
        assert read_corpus(spark, tables, "labels", "doc_id", "toxic").rdd.getNumPartitions() == 7
        spark.conf.unset("textmill.input.partitions")
        assert read_corpus(spark, tables, "labels", "doc_id", "toxic").rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("textmill.input.partitions", was)
