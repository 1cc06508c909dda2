"""Training: from labelled texts to an evaluated, stored classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.config import ModelConfig, SearchGrids
from textmill.fixed_values import UNKNOWN_LABEL
from textmill.functions.text import preprocess
from textmill.models import linear as L
from textmill.models import tuning as U
from textmill.models.features import TextFeatures
from textmill.models.scoring import TextClassifier
from textmill.operators.augment import augment_dataset
from textmill.operators.evaluate import (
    classification_report, confusion_counts, confusion_matrix, normalized_confusion,
    overall_metrics,
)
from textmill.operators.split import train_test_split
from textmill.operators.stats import label_counts
from textmill.session import materialize


@dataclass(frozen=True)
class TrainingResult:
    classifier: TextClassifier
    model_name: str
    ranking: DataFrame
    class_distribution: DataFrame
    cross_validation: DataFrame | None
    learning_curve: DataFrame | None
    predictions: DataFrame
    overall: DataFrame
    report: DataFrame
    confusion: DataFrame

    def save(self, base: str) -> None:
        """The model below ``models`` and the report tables below ``output``."""
        self.classifier.save(f"{base}/models")
        tables = {
            "class_distribution": self.class_distribution,
            "cross_validation": self.cross_validation,
            "learning_curve": self.learning_curve,
            "confusion_matrix": self.confusion,
            "overall": self.overall,
            "report": self.report,
        }
        for name, table in tables.items():
            if table is not None:
                table.write.mode("overwrite").parquet(f"{base}/output/{name}")


def feature_extractor(config: ModelConfig, text_col: str = "text", label_col: str = "label") -> TextFeatures:
    return TextFeatures(
        text_col, label_col, config.max_features, config.min_df, config.max_df,
        config.ngram_range, True, config.char_ngram_range, config.char_max_features,
        config.sublinear_tf,
    )


def train(
    corpus: DataFrame, id_col: str = "row_id", config: ModelConfig = ModelConfig(),
    grids: SearchGrids = SearchGrids(), with_curve: bool = True,
) -> TrainingResult:
    """Preprocess, split, augment, featurise, tune, vote, evaluate.

    ``corpus`` has ``text``, ``label`` and a unique id.  The split comes before
    the augmentation, so no copy of a test row is trained on.  Each intermediate
    that later passes read again is written to the shared folder, once.  A row
    without a label counts as one of the unknown label.
    """
    cleaned = corpus.select(
        F.col(id_col).cast("string").alias("id"), preprocess("text").alias("text"),
        F.coalesce("label", F.lit(UNKNOWN_LABEL)).alias("label"),
    )
    split = materialize(train_test_split(cleaned, "id", "label", config.test_size, config.seed), "split")
    training = split.filter(~F.col("is_test")).drop("is_test")
    testing = split.filter("is_test").drop("is_test")
    if config.use_augmentation:
        training = augment_dataset(
            training, "id", "text", config.augmentation_factor, config.augmentation_methods, config.seed
        ).withColumn("id", F.concat_ws("#", "id", "copy_no")).drop("copy_no")
    folds = config.fast_cv_folds if config.use_ensemble else config.cv_folds
    training = U.with_folds(
        training, "id", folds, config.seed, grids.calibration_folds, config.learning_curve_steps,
        "label", config.cv_folds,
    )
    training = materialize(training, "training")

    features = feature_extractor(config).fit(training)
    n_classes, n_terms = features.num_classes, features.vocabulary_size
    # The one copy of the features: every pass reads these blocks.
    rows = materialize(features.packed(training, ("fold", "curve_fold", "cal_fold", "step")), "features")
    cv = None
    if config.use_ensemble:
        tuned = U.tune_all_classifiers(rows, n_classes, n_terms, config, grids)
        name = "ensemble"
        onlys = [(), *[(("fold", "!=", f),) for f in range(folds)]]
        # The model and those of its folds are fitted together.
        models = dict(zip(onlys, U.create_ensembles(rows, tuned, n_classes, n_terms, config.top_n, grids, onlys)))
        model = models[()]
        scores = U.cross_validate(rows, folds, models.get)
        cv = corpus.sparkSession.createDataFrame(
            [(name, f, float(a)) for f, a in enumerate(scores)], "model string, fold int, accuracy double")
    else:
        tuned = U.tune_hyperparameters(rows, n_classes, n_terms, config)
        best = U.best_of(tuned)[0]
        if not best.gives_probabilities:
            best = U.refit(rows, best, n_classes, n_terms, True, grids)
        model, name = L.Ensemble((best,), (1.0,)), best.name
    curve = None
    if with_curve:
        curve = U.learning_curve(
            rows.withColumn("fold", F.col("curve_fold")), U.best_of(tuned)[0], n_classes, n_terms,
            config.cv_folds, config.learning_curve_steps,
        )
        curve = materialize(curve, "curve")
    classifier = TextClassifier(features, model)
    predictions = materialize(
        classifier.predictions(features.transform(testing)).select("id", "label", "prediction"),
        "predictions",
    )
    confusion = confusion_counts(predictions, "label", "prediction")
    return TrainingResult(
        classifier=classifier,
        model_name=name,
        ranking=U.ranking(corpus.sparkSession, tuned),
        class_distribution=label_counts(training, "label"),
        cross_validation=cv,
        learning_curve=curve,
        predictions=predictions,
        overall=overall_metrics(confusion),
        report=classification_report(confusion),
        confusion=normalized_confusion(confusion_matrix(confusion)),
    )
