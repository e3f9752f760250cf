"""Every query of the library with its SQL."""

from __future__ import annotations

from .plans import choice, counts, features, fitted, learners, models, more, results, tabular, weights
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "choice", "counts", "features", "fitted", "learners", "models", "more", "results", "tabular", "weights"]

FLAGSHIP = "feature_portfolio"
