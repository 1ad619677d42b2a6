"""Names of the training contract."""

from __future__ import annotations

# The nine algorithm names of the training contract, the hyper-parameter names each accepts, and
# the names of problem types, imputers and reductions.
PROBLEM_TYPES = ("regression", "classification")
ALGORITHMS = ("random_forest", "gradient_boosting", "xgboost", "adaboost",
              "random_forest_classifier", "gradient_boosting_classifier", "xgboost_classifier",
              "adaboost_classifier", "logistic_regression")
ALLOWED_PARAMS = {
    "random_forest": ("n_estimators", "min_samples_leaf", "max_depth", "min_samples_split", "max_leaf_nodes"),
    "gradient_boosting": ("n_estimators", "learning_rate", "max_depth", "subsample"),
    "xgboost": ("n_estimators", "verbosity", "learning_rate", "max_depth", "gamma", "subsample"),
    "adaboost": ("n_estimators", "learning_rate", "loss"),
    "random_forest_classifier": ("n_estimators", "min_samples_leaf", "max_depth", "min_samples_split",
                                 "max_leaf_nodes"),
    "gradient_boosting_classifier": ("n_estimators", "learning_rate", "max_depth", "subsample"),
    "xgboost_classifier": ("n_estimators", "verbosity", "learning_rate", "max_depth", "gamma", "subsample"),
    "adaboost_classifier": ("n_estimators", "learning_rate"),
    "logistic_regression": ("penalty", "solver", "C"),
}
NUMERIC_IMPUTERS = ("median", "mean", "most_frequent", "constant", "drop")
CATEGORICAL_IMPUTERS = ("most_frequent", "constant")
REDUCTIONS = ("none", "truncated_svd")
