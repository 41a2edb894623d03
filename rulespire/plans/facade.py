"""One-call classifier: hold-out, model choice by size, fit, prune, calibrate, explain."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from rulespire.config import FitConfig
from rulespire.functions.hashing import unit_hash
from rulespire.functions.rules import ANY, BEST, FAMILIES
from rulespire.operators.calibrate import binned_apply, binned_fit, monotone_fit, platt_apply, platt_fit
from rulespire.operators.certificates import backend_labels, require_certified
from rulespire.operators.explain import explain_rows
from rulespire.operators.profile import require_valid
from rulespire.operators.prune import prune
from rulespire.plans.boost import fit_boosting
from rulespire.plans.forest import fit_forest, score_forest
from rulespire.plans.grow import fit_tree
from rulespire.plans.model import accuracy, root_paths, score_rows


def choose_model(n_train: int, requested: str = "auto") -> str:
    """single below 500 rows, forest below 2000, boosting from there."""
    if requested != "auto":
        return requested
    return "single" if n_train < 500 else "forest" if n_train < 2000 else "boosting"


@dataclass
class RuleClassifier:
    """Estimator over DataFrames with named feature columns."""

    features: list[str]
    label: str = "y"
    row_key: str = "rk"
    model_type: str = "auto"
    family: str = BEST
    max_depth: int = 5
    max_arity: int = 3
    min_samples_leaf: int = 5
    min_samples_split: int = 10
    n_bins: int = 64
    n_estimators: int = 20
    learning_rate: float = 0.05
    use_calibration: bool = True
    calibration_method: str = "platt"
    use_pruning: bool = True
    pruning_alpha: float = 0.01
    strict_family: bool = False
    seed: int = 42
    min_gain: float = 1e-7
    complexity_penalty: float = 0.0
    laplace: float = 1.0
    allow_affine: bool = False
    allow_compare: bool = False
    use_interactions: bool = False
    use_gain_ratio: bool = False
    look_ahead: bool = False
    limit_2d: int | None = None
    limit_3d: int | None = None
    binning: str = "local"
    model_: object = field(default=None, init=False)
    kind_: str | None = field(default=None, init=False)
    calibrator_: tuple | None = field(default=None, init=False)

    def __post_init__(self):
        if self.model_type not in ("auto", "single", "forest", "boosting"):
            raise ValueError(f"unknown model type: {self.model_type}")
        if self.family not in (*FAMILIES, ANY, BEST):
            raise ValueError(f"unknown family: {self.family}")
        if not 1 <= self.max_arity <= 3:
            raise ValueError("max_arity is 1, 2 or 3")
        if self.calibration_method not in ("platt", "isotonic", "monotone"):
            raise ValueError(f"unknown calibration method: {self.calibration_method}")

    def _config(self, depth: int, bins: int) -> FitConfig:
        return FitConfig(family=self.family, max_depth=depth, n_bins=bins, min_samples_leaf=self.min_samples_leaf,
                         min_samples_split=self.min_samples_split, max_arity=self.max_arity,
                         strict_family=self.strict_family, seed=self.seed, min_gain=self.min_gain,
                         complexity_penalty=self.complexity_penalty, laplace=self.laplace, allow_affine=self.allow_affine,
                         allow_compare=self.allow_compare, use_interactions=self.use_interactions, use_gain_ratio=self.use_gain_ratio,
                         look_ahead=self.look_ahead, limit_2d=self.limit_2d, limit_3d=self.limit_3d, binning=self.binning)

    def fit(self, df: DataFrame) -> "RuleClassifier":
        if self.strict_family and self.family == ANY:
            raise ValueError("strict family mode needs one family, not Any")
        n = require_valid(df, self.label, self.features)
        hold = self.use_calibration or self.use_pruning
        u = unit_hash(self.seed, "cal", F.col(self.row_key))
        train = df.filter(u >= 0.15) if hold else df
        held = df.filter(u < 0.15) if hold else None
        self.kind_ = choose_model(train.count() if hold and self.model_type == "auto" else n, self.model_type)
        if self.kind_ == "single":
            self.model_ = fit_tree(train, self.label, self.features, self._config(self.max_depth, self.n_bins))
            if self.use_pruning:
                prune(self.model_, held, self.label, self.pruning_alpha)
        elif self.kind_ == "forest":
            self.model_ = fit_forest(train, self.label, self.features, self.row_key, self.n_estimators,
                                     cfg=self._config(min(self.max_depth, 10), min(self.n_bins, 40)), seed=self.seed)
        else:
            self.model_ = fit_boosting(train, self.label, self.features, self.row_key, 2 * self.n_estimators,
                                       self.learning_rate, min_leaf=self.min_samples_leaf, seed=self.seed)
        if self.use_calibration:
            scored = self._raw(held)
            if self.calibration_method == "platt":
                self.calibrator_ = ("platt", *platt_fit(scored, "proba", self.label))
            elif self.calibration_method == "monotone":
                blocks = monotone_fit(scored, "proba", self.label).orderBy("lo").collect()  # one per step
                self.calibrator_ = ("isotonic", [(x, r["rate"]) for r in blocks for x in dict.fromkeys((r["lo"], r["hi"]))]) if blocks else None
            else:
                knots = binned_fit(scored, "proba", self.label).orderBy("mean_p").collect()  # at most 20 rows
                self.calibrator_ = ("isotonic", [(r["mean_p"], r["rate"]) for r in knots]) if knots else None
        return self

    def _fitted(self):
        if self.model_ is None:
            raise RuntimeError("fit the classifier first")
        return self.model_

    def _raw(self, df: DataFrame) -> DataFrame:
        model = self._fitted()
        if self.kind_ == "single":
            return score_rows(df, model)
        if self.kind_ == "forest":
            return score_forest(df, model)
        return df.withColumn("proba", model.proba_column())

    def predict(self, df: DataFrame) -> DataFrame:
        """Add calibrated proba and pred."""
        out = self._raw(df)
        if self.calibrator_ and self.calibrator_[0] == "platt":
            out = out.withColumn("proba", platt_apply(F.col("proba"), *self.calibrator_[1:]))
        elif self.calibrator_:
            knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in self.calibrator_[1]])
            out = out.withColumn("proba", binned_apply(F.col("proba"), knots))
        return out.withColumn("pred", (F.col("proba") >= 0.5).cast("int"))

    def score(self, df: DataFrame) -> float:
        return accuracy(self.predict(df), "pred", self.label).first()["accuracy"]

    def explain(self, df: DataFrame, strict: bool = False) -> DataFrame:
        """Add y_pred, axp and axp_len; ``strict`` refuses a tree with a path that has no certificate."""
        self._fitted()
        if self.kind_ != "single":
            raise NotImplementedError("explanations exist for single trees only")
        if strict:
            nodes = self.model_.frame(df.sparkSession)
            deepest = max(n.depth for n in self.model_.leaves())
            rules = nodes.filter("not is_leaf").select("tree_id", "node_id", "family", "combine", "lits")
            require_certified(backend_labels(root_paths(nodes, deepest).join(rules, ["tree_id", "node_id"])))
        return explain_rows(df, self.model_)

    def summary(self) -> dict:
        model = self._fitted()
        if self.kind_ != "single":
            return {"kind": self.kind_}
        leaves = model.leaves()
        return {"kind": "single", "n_nodes": len(model.nodes), "n_leaves": len(leaves), "n_internal": len(model.splits()), "depth": max(n.depth for n in leaves)}
