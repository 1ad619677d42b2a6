"""tessera: tabular machine-learning data work as Spark DataFrame jobs.

Sub-packages
------------
sources    readers and writers (CSV with encoding fallback, JSON records, dataset store, logs)
functions  column expressions shared by operators (NA rules, coercion, metric terms)
operators  profiling, validation, feature preparation, folds, metrics, scoring,
           estimators, registry and job-log folds
plans      the query catalogue: fixture derivations from the given tables and the
           named queries with their SQL twins
streaming  Structured Streaming entry points that reuse the batch operators
"""

from tessera.session import get_session, scratch_path, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
