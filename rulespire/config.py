"""Fit settings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from rulespire.functions.rules import BEST


@dataclass(frozen=True)
class FitConfig:
    """All settings of a rule-tree fit."""

    family: str = BEST
    max_depth: int = 5
    min_samples_split: int = 10
    min_samples_leaf: int = 5
    min_gain: float = 1e-7
    purity: float = 0.99
    complexity_penalty: float = 0.0
    n_bins: int = 64
    binning: str = "local"  # or edges fixed before growth: quantile, width, density, supervised
    root_score: str = "bins"  # information of the features at the root: of their bins, or from neighbours
    prune_holdout: float = 0.0  # share of a stratified hold-out that prunes the tree, from 500 rows on
    prune_alpha: float = 0.01
    top_k: int = 15
    search_1d: bool = True
    search_2d: bool = True
    search_3d: bool = True
    limit_2d: int | None = None
    limit_3d: int | None = None
    max_bins_3d: int = 32
    max_arity: int = 3
    use_gain_ratio: bool = False
    laplace: float = 1.0
    allow_affine: bool = False
    allow_compare: bool = False
    use_interactions: bool = False
    strict_family: bool = False
    cnf_features: int = 10
    cnf_thresholds: int = 8
    cnf_candidates: int = 500
    look_ahead: bool = False
    look_ahead_gamma: float = 0.3
    look_ahead_top: int = 5
    max_codes: int = 1024
    seed: int = 42

    def pair_features(self, d: int) -> int:
        return self.limit_2d or max(10, int(2 * d**0.5))

    def triple_features(self, d: int) -> int:
        return self.limit_3d or max(6, int(1.5 * d ** (1 / 3)))


def for_width(d: int, max_distinct: int | None = None, base: FitConfig | None = None) -> FitConfig:
    """Settings by table width: wide tables get fewer bins and no triples."""
    base = base or FitConfig()
    if d > 500:
        cfg = replace(base, n_bins=16, search_3d=False, top_k=10)
    elif d > 100:
        cfg = replace(base, n_bins=32, search_3d=False, top_k=12)
    else:
        cfg = replace(base, n_bins=64, search_3d=d <= 50, top_k=15)
    if max_distinct is not None and max_distinct <= 3:
        cfg = replace(cfg, n_bins=min(cfg.n_bins, 8))
    return cfg
