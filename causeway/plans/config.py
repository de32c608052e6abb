"""Parameters of the walk-forward forecast."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ForecastConfig:
    # Names and defaults of the saved run files.
    window: int = 20
    signature_depth: int = 3
    regime_depth: int = 2
    horizon: int = 1
    lasso_alpha: float = 5e-4
    regime_gamma: float = 0.5
    correlation_min: float = 0.05
    collinearity_max: float = 0.95
    max_factors: int = 8
    regime_factors: int = 3
    max_train: int = 756
    lasso_passes: int = 80
    max_selected: int = 20

    def check(self) -> ForecastConfig:
        """The configuration itself; ValueError if a value is out of range."""
        within = {"window": (5, 252), "signature_depth": (1, 4), "regime_depth": (1, 3), "horizon": (1, 20), "max_train": (100, math.inf), "correlation_min": (0, 1), "collinearity_max": (0, 1)}
        within |= {name: (0, math.inf) for name in ("lasso_alpha", "regime_gamma")}
        within |= {name: (1, math.inf) for name in ("max_factors", "regime_factors", "lasso_passes", "max_selected")}
        outside = {"correlation_min": 1, "collinearity_max": 0}
        for name, (low, high) in within.items():
            value = getattr(self, name)
            if not low <= value <= high or value == outside.get(name):
                raise ValueError(f"{name} must be in [{low}, {high}]" + (f", but not {value}" if name in outside else ""))
        return self


#: The four candidates that validation chooses from.
CANDIDATES = {
    "depth2_sparse": ForecastConfig(signature_depth=2, lasso_alpha=5e-4),
    "depth2_less_sparse": ForecastConfig(signature_depth=2, lasso_alpha=1e-4),
    "depth3_less_sparse": ForecastConfig(signature_depth=3, lasso_alpha=1e-4),
    "depth2_stronger_weight": ForecastConfig(signature_depth=2, lasso_alpha=1e-4, regime_gamma=1.0),
}


def table(spark: SparkSession, configs: Mapping[str, ForecastConfig]) -> DataFrame:
    """candidate, field and value of every setting."""
    rows = [(name, field, float(value)) for name, config in configs.items() for field, value in asdict(config).items()]
    return spark.createDataFrame(rows, "candidate string, field string, value double")


def from_run_info(info: Mapping) -> ForecastConfig:
    """The settings of a saved run, checked; fields that it lacks have their defaults."""
    return ForecastConfig(**info["config"]).check()
