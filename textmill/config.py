"""Defaults of the operators, kept as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ModelConfig:
    seed: int = 42
    test_size: float = 0.2
    cv_folds: int = 5
    fast_cv_folds: int = 3
    max_features: int = 5000
    min_df: int = 3
    max_df: float = 0.90
    ngram_range: tuple[int, int] = (1, 2)
    char_ngram_range: tuple[int, int] = (2, 5)
    char_max_features: int = 3000
    sublinear_tf: bool = True
    use_augmentation: bool = True
    augmentation_factor: int = 2
    augmentation_methods: tuple[str, ...] = ("shuffle", "delete", "duplicate")
    use_ensemble: bool = True
    top_n: int = 3
    svm_c_values: tuple[float, ...] = (0.1, 0.3, 0.5, 1.0)
    svm_max_iter: int = 2000
    lr_c_values: tuple[float, ...] = (0.1, 0.3, 0.5, 1.0)
    lr_max_iter: int = 1000
    nb_alpha: float = 0.1
    ensemble_weights: tuple[int, ...] = (2, 2, 1)
    learning_curve_steps: int = 10
    overfit_gap: float = 0.1


@dataclass(frozen=True)
class SearchGrids:
    """Grids of the five-way search."""

    svm_c: tuple[float, ...] = (0.5, 1.0, 2.0)
    svm_max_iter: int = 5000
    lr_c: tuple[float, ...] = (0.5, 1.0, 2.0, 5.0)
    lr_max_iter: int = 2000
    nb_alpha: tuple[float, ...] = (0.01, 0.1, 0.5, 1.0)
    sgd_alpha: tuple[float, ...] = (1e-4, 1e-3)
    sgd_loss: tuple[str, ...] = ("hinge", "log_loss")
    sgd_max_iter: int = 2000
    sgd_tol: float = 1e-3
    calibration_folds: int = 3


@dataclass(frozen=True)
class DatasetConfig:
    resume_csv: str = "Resume.csv"
    updated_csv: str = "UpdatedResumeDataSet.csv"
    corpus_csv: str = "ResumesCorpusDataSet.csv"
    resume_text_column: str = "Resume_str"
    category_column: str = "Category"
    remove_duplicates: bool = True
    drop_na: bool = True


@dataclass(frozen=True)
class PathConfig:
    """All paths hang below ``base_dir``, which may be any Hadoop path."""

    base_dir: str = "."
    output_dir: str = "output"
    model_dir: str = "models"

    def output(self, name: str) -> str:
        return f"{self.base_dir}/{self.output_dir}/{name}"

    def model(self) -> str:
        return f"{self.base_dir}/{self.model_dir}"


@dataclass(frozen=True)
class DataQualityConfig:
    similarity_threshold: float = 0.9
    min_length: int = 100
    min_samples_per_label: int = 20


@dataclass(frozen=True)
class ConfidenceThresholds:
    high: float = 0.7
    medium: float = 0.4


@dataclass(frozen=True)
class EngineConfig:
    model: ModelConfig = field(default_factory=ModelConfig)
    grids: SearchGrids = field(default_factory=SearchGrids)
    dataset: DatasetConfig = field(default_factory=DatasetConfig)
    quality: DataQualityConfig = field(default_factory=DataQualityConfig)
    thresholds: ConfidenceThresholds = field(default_factory=ConfidenceThresholds)
