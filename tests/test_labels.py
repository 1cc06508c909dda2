import pytest
from pyspark.sql import functions as F

from textmill.config import ConfidenceThresholds, DatasetConfig, ModelConfig, PathConfig
from textmill.fixed_values import EXTRA_LABEL_MAP, KEYWORD_GROUPS, LABEL_MAP, STOPWORDS
from textmill.functions import labels as lab


def apply(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("AUTOMOBILE", "Automobile"), ("FURNITURE", "Furniture"),
        ("Software_Developer", "Software Developer"), (" hr ", "HR"), ("", "Unknown"),
        (None, "Unknown"), ("  ", "Unknown"), (".NET Developer", ".NET Developer"),
        ("Devops Engineer", "Devops Engineer"), ("DEVOPS ENGINEER", "Devops Engineer"),
        ("sap developer", "sap developer"), ("hadoop", "Hadoop"),
        ("network_security engineer", "Network Security Engineer"), ("Web Designing", "Designer"),
        ("BUSINESS-DEVELOPMENT", "Business-Development"), ("made up role", "made up role"),
    ],
)
def test_normalize_label(spark, raw, expected):
    assert apply(spark, raw, lab.normalize_label) == expected


def test_extra_rows_are_an_option(spark):
    wide = {**LABEL_MAP, **EXTRA_LABEL_MAP}
    assert apply(spark, "sap developer", lambda c: lab.normalize_label(c, wide)) == "SAP Developer"
    assert apply(spark, ".NET Developer", lambda c: lab.normalize_label(c, wide)) == "DotNet Developer"


@pytest.mark.parametrize("raw", ["o'neil x2y é-a", "HTML5 dev", "a", "über-cool 3d"])
def test_title_case(spark, raw):
    assert apply(spark, raw, lab.title_case) == raw.title()


@pytest.mark.parametrize(
    "text, label, expected",
    [
        ("Python developer, SQL and AWS", "AUTOMOBILE", "Information-Technology"),
        ("Automotive mechanic, vehicle repair", "AUTOMOBILE", None),
        ("Attorney at a law firm, paralegal", "Automobile", "Advocate"),
        ("USAA automobile and vehicle claims", "AUTOMOBILE", "Finance"),
        ("A rapid learner", "BPO", "Information-Technology"),
        ("Call center BPO operations", "BPO", None),
        ("Python developer", "HR", None),
        ("Gardening", "AUTOMOBILE", None),
    ],
)
def test_detect_mislabel(spark, text, label, expected):
    df = spark.createDataFrame([(text, label)], "t string, l string")
    assert df.select(lab.detect_mislabel("t", "l").alias("r")).first()["r"] == expected


def test_path_and_parents(spark):
    assert apply(spark, "Python Developer", lab.label_path) == [
        "Technology", "Software Development", "Python Developer"]
    assert apply(spark, "NoSuch", lab.label_path) == ["Professional", "NoSuch"]
    for c, parent in [("Python Developer", "Software Development"),
                      ("Software Development", "Technology"), ("Finance", "Finance"), ("NoSuch", None)]:
        assert apply(spark, c, lab.label_parent) == parent


@pytest.mark.parametrize(
    "label, levels, expected",
    [("Python Developer", 1, "Software Development"), ("Python Developer", 2, "Technology"),
     ("Python Developer", 9, "Technology"), ("Software Development", 1, "Professional")],
)
def test_climb(spark, label, levels, expected):
    assert apply(spark, label, lambda c: lab.climb(c, levels)) == expected


def test_validity(spark):
    assert apply(spark, "Python Developer", lab.is_leaf) is True
    assert apply(spark, "NonExistent Category", lab.is_leaf) is False


def test_consensus(spark):
    def consensus(values):
        df = spark.createDataFrame([(values,)], "v array<string>")
        return df.select(lab.consensus_domain(F.col("v")).alias("r")).first()["r"]

    assert consensus(["Sales", "Python Developer", "Java Developer"]) == "Technology"
    assert consensus(["Sales", "Python Developer"]) == "Business & Management"
    assert consensus([]) == "Professional"


@pytest.mark.parametrize(
    "confidence, tier, category, review",
    [(0.85, "high", "Python Developer", False), (0.7, "high", "Python Developer", False),
     (0.55, "medium", "Software Development", False), (0.4, "medium", "Software Development", False),
     (0.25, "low", "Technology", True)],
)
def test_select_by_confidence(spark, confidence, tier, category, review):
    tops = F.array(*[F.lit(c) for c in ("Python Developer", "Java Developer", "Web Developer")])
    df = spark.range(1).select(
        lab.select_by_confidence(F.lit("Python Developer"), F.lit(confidence), tops).alias("s"))
    s = df.first()["s"]
    assert (s["tier"], s["category"], s["requires_review"]) == (tier, category, review)
    assert (s["top_suggestions"] is None) == (tier != "low")


def test_defaults():
    c = ModelConfig()
    assert c.seed == 42 and 0 < c.test_size < 1 and c.cv_folds > 0 and c.max_features > 0
    assert len(c.svm_c_values) > 0
    t = ConfidenceThresholds()
    assert 0 <= t.medium <= t.high <= 1
    d = DatasetConfig()
    assert d.remove_duplicates and d.drop_na
    assert PathConfig().output_dir == "output"
    assert len(set(STOPWORDS)) == 132 and len(LABEL_MAP) == 64 and len(lab.LEAF_PATHS) == 46
    assert [len(v) for v in KEYWORD_GROUPS.values()] == [10, 7, 19, 9, 9, 5, 5, 6]
