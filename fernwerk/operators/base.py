"""Learners and models: pyspark.ml estimators and models with plain attributes, so that they stand in a Pipeline and pickle."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame


class Varied:
    def with_options(self, **options):
        """A copy with other options; what grid search varies."""
        out = self.copy()
        for k, v in options.items():
            if not hasattr(out, k):
                raise AttributeError(f"{type(self).__name__} has no option {k}")
            setattr(out, k, v)
        return out


class Learner(Varied, Estimator):
    """fit(df) -> Fitted. Columns: id (order and ties), features, label, and by option weight."""

    def __init__(self, features: str = "features", label: str = "label", id: str = "id", prediction: str = "prediction", **options):
        super().__init__()
        self.features, self.label, self.id, self.prediction = features, label, id, prediction
        for k, v in options.items():
            setattr(self, k, v)

    def _columns(self) -> dict[str, str]:
        return {"features": self.features, "label": self.label, "id": self.id, "prediction": self.prediction}


class Fitted(Varied, Model):
    """transform(df) -> df with column `prediction`, or with `features` changed."""

    def __init__(self, features: str = "features", label: str = "label", id: str = "id", prediction: str = "prediction", **state):
        super().__init__()
        self.features, self.label, self.id, self.prediction = features, label, id, prediction
        for k, v in state.items():
            setattr(self, k, v)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raise NotImplementedError
