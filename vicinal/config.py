"""Settings of a study: frozen, with ranges, no unknown keys; to and from YAML or JSON files."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any, TypeVar

from vicinal.functions.scalars import sha256_of

C = TypeVar("C", bound="Config")


def within(value: float, low: float, high: float, name: str) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} is {value}; it must be from {low} to {high}")


def one_of(value: str, known: tuple[str, ...], name: str) -> None:
    if value not in known:
        raise ValueError(f"{name} is {value}; it must be one of {', '.join(known)}")


@dataclass(frozen=True)
class Config:
    @classmethod
    def of(cls: type[C], data: dict[str, Any]) -> C:
        """From nested dicts; a key that isn't a field is an error."""
        known = {f.name: f for f in fields(cls)}
        if extra := data.keys() - known.keys():
            raise ValueError(f"unknown settings in {cls.__name__}: {', '.join(sorted(extra))}")
        nested = {n: f.default_factory for n, f in known.items() if f.default_factory is not dataclasses.MISSING and isinstance(f.default_factory, type) and issubclass(f.default_factory, Config)}
        return cls(**{k: nested[k].of(v) if k in nested and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in data.items()})

    def plain(self) -> dict[str, Any]:
        return json.loads(json.dumps(dataclasses.asdict(self)))

    def sha256(self) -> str:
        return sha256_of(self.plain())

    def save(self, path: str | Path) -> None:
        Path(path).write_text(_dump(self.plain(), Path(path).suffix))

    @classmethod
    def load(cls: type[C], path: str | Path) -> C:
        """A missing file is an error."""
        text = Path(path).read_text()
        if Path(path).suffix == ".json":
            return cls.of(json.loads(text))
        import yaml

        return cls.of(yaml.safe_load(text) or {})


def _dump(data: dict[str, Any], suffix: str) -> str:
    if suffix == ".json":
        return json.dumps(data, indent=2, sort_keys=True)
    import yaml

    return yaml.safe_dump(data, sort_keys=True)


@dataclass(frozen=True)
class DatasetConfig(Config):
    name: str = "synthetic"
    cell_key: str = "cell_id"
    donor_key: str = "donor_id"
    label_key: str = "cell_type"
    site_key: str = "site"
    min_cells_per_donor: int = 1

    def __post_init__(self) -> None:
        within(self.min_cells_per_donor, 0, 10**9, "min_cells_per_donor")


@dataclass(frozen=True)
class SplitConfig(Config):
    kind: str = "site_stratified"
    train: float = 0.6
    val: float = 0.2
    test: float = 0.2
    seed: int = 42
    min_train_cells_per_class: int = 20
    rare_class_action: str = "warn"

    def __post_init__(self) -> None:
        one_of(self.kind, ("site_stratified", "random_debug"), "kind")
        one_of(self.rare_class_action, ("warn", "fail"), "rare_class_action")
        within(self.train, 0.1, 0.9, "train")
        if abs(self.train + self.val + self.test - 1) > 1e-5:
            raise ValueError("the shares of a split must sum to 1")


@dataclass(frozen=True)
class PreprocessingConfig(Config):
    target_sum: float = 1e4
    genes: int = 2000
    bins: int = 20
    components: int = 50
    clip: float | None = 10.0

    def __post_init__(self) -> None:
        within(self.genes, 1, 10**6, "genes")
        within(self.components, 1, 10**4, "components")


@dataclass(frozen=True)
class GraphConfig(Config):
    name: str = "pca_knn"
    k: int = 20
    symmetrise: bool = True
    weighted: bool = False
    swap_factor: int = 10

    def __post_init__(self) -> None:
        one_of(self.name, ("pca_knn", "mutual_knn", "bbknn", "rewired_control"), "name")
        within(self.k, 1 if self.name == "bbknn" else 2, 100, "k")


@dataclass(frozen=True)
class ModelConfig(Config):
    """Settings of one model; `default` gives those of its kind."""

    name: str = "mlp"
    hidden: tuple[int, ...] = (128, 128)
    dropout: float = 0.3
    rate: float = 1e-3
    decay: float = 1e-4
    batch: int = 256
    epochs: int = 500
    patience: int = 50
    cs: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
    class_weights: tuple[str, ...] = ("none", "balanced")
    iterations: int = 1000

    def __post_init__(self) -> None:
        one_of(self.name, ("logistic_regression", "mlp", "gcn", "graphsage", "centroid"), "name")
        within(self.dropout, 0, 0.95, "dropout")
        within(self.batch, 1, 10**6, "batch")
        within(self.epochs, 1, 10**5, "epochs")

    @classmethod
    def default(cls, name: str) -> ModelConfig:
        """Graph models have one hidden layer and a lower dropout."""
        return cls(name, (128,), 0.2) if name in ("gcn", "graphsage") else cls(name)


@dataclass(frozen=True)
class StudyConfig(Config):
    dataset: DatasetConfig = field(default_factory=DatasetConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    preprocessing: PreprocessingConfig = field(default_factory=PreprocessingConfig)
    graph: GraphConfig = field(default_factory=GraphConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    seeds: tuple[int, ...] = (7, 17, 42, 73, 101)
