"""Audit queries over request tables."""

from __future__ import annotations

from tessera.operators import audit as A
from tessera.plans.catalog import query
from tessera.plans.requests import (ALLOWED_SQL, CATALOGUE_SQL, SCORING_REQUESTS_SQL, TRAINING_REQUESTS_SQL,
                                    allowed_params, column_catalogue, scoring_requests, training_requests)


@query("contract_audit", f"""
WITH r AS ({TRAINING_REQUESTS_SQL}), cat AS ({CATALOGUE_SQL}),
f AS (SELECT request_id, dataset_id, unnest(feature_columns) AS column_name FROM r),
missing AS (SELECT request_id, 'missing_feature' AS problem, column_name FROM f
            WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.dataset_id = f.dataset_id AND cat.column_name = f.column_name)),
t AS (SELECT r.request_id,
             CASE WHEN cat.ml_type IS NULL THEN 'missing_target'
                  WHEN list_contains(r.feature_columns, r.target_column) THEN 'target_is_feature'
                  WHEN r.problem_type = 'regression' AND cat.ml_type <> 'numeric' THEN 'target_not_numeric' END AS problem,
             r.target_column AS column_name
      FROM r LEFT JOIN cat ON cat.dataset_id = r.dataset_id AND cat.column_name = r.target_column)
SELECT * FROM missing UNION ALL SELECT * FROM t WHERE problem IS NOT NULL
UNION ALL SELECT request_id, 'test_missing_feature', column_name FROM (SELECT request_id, test_dataset_id, unnest(feature_columns) AS column_name FROM r) f
WHERE test_dataset_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cat WHERE cat.dataset_id = f.test_dataset_id AND cat.column_name = f.column_name)
UNION ALL SELECT request_id, 'test_missing_target', target_column FROM r
WHERE test_dataset_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cat WHERE cat.dataset_id = r.test_dataset_id AND cat.column_name = r.target_column)""")
def q_contract_audit(spark, sf_dir):
    return A.contract_audit(training_requests(spark, sf_dir), column_catalogue(spark, sf_dir))


@query("request_audit", f"""
WITH r AS ({TRAINING_REQUESTS_SQL}), allowed AS ({ALLOWED_SQL}),
hp AS (SELECT request_id, algorithm, hp_keys[i] AS param, hp_values[i] AS value
       FROM r, range(1, len(hp_keys) + 1) t(i)),
lr AS (SELECT request_id, max(CASE WHEN param = 'penalty' THEN lower(value) END) AS penalty,
              max(CASE WHEN param = 'solver' THEN lower(value) END) AS solver FROM hp GROUP BY request_id),
checks AS (
  SELECT request_id, 'bad_algorithm' AS problem, algorithm AS detail FROM r WHERE algorithm NOT IN (SELECT algorithm FROM allowed)
  UNION ALL SELECT request_id, 'bad_problem_type', problem_type FROM r WHERE problem_type NOT IN ('regression', 'classification')
  UNION ALL SELECT request_id, CASE WHEN problem_type = 'classification' AND NOT (algorithm LIKE '%\\_classifier' ESCAPE '\\' OR algorithm = 'logistic_regression') THEN 'classification_needs_classifier'
                          WHEN problem_type = 'regression' AND (algorithm LIKE '%\\_classifier' ESCAPE '\\' OR algorithm = 'logistic_regression') THEN 'regression_with_classifier' END AS problem,
         algorithm AS detail FROM r
  UNION ALL SELECT r.request_id, CASE WHEN algorithm = 'logistic_regression' AND lr.penalty = 'l1' AND lr.solver = 'lbfgs' THEN 'l1_with_lbfgs' END,
         'penalty=l1,solver=lbfgs' FROM r LEFT JOIN lr ON lr.request_id = r.request_id
  UNION ALL SELECT request_id, CASE WHEN NOT cv_folds BETWEEN 2 AND 10 THEN 'cv_folds_out_of_range' END, CAST(cv_folds AS VARCHAR) FROM r
  UNION ALL SELECT request_id, CASE WHEN NOT svd_components BETWEEN 2 AND 100 THEN 'svd_components_out_of_range' END, CAST(svd_components AS VARCHAR) FROM r
  UNION ALL SELECT request_id, CASE WHEN len(feature_columns) < 1 THEN 'no_features' END, '' FROM r
  UNION ALL SELECT request_id, CASE WHEN NOT length(model_name) BETWEEN 2 AND 80 THEN 'model_name_length' END, model_name FROM r
  UNION ALL SELECT request_id, CASE WHEN numeric_imputer NOT IN ('median', 'mean', 'most_frequent', 'constant', 'drop') THEN 'bad_numeric_imputer' END, numeric_imputer FROM r
  UNION ALL SELECT request_id, CASE WHEN categorical_imputer NOT IN ('most_frequent', 'constant') THEN 'bad_categorical_imputer' END, categorical_imputer FROM r
  UNION ALL SELECT request_id, CASE WHEN dimension_reduction NOT IN ('none', 'truncated_svd') THEN 'bad_dimension_reduction' END, dimension_reduction FROM r)
SELECT * FROM checks WHERE problem IS NOT NULL
UNION ALL
SELECT request_id, 'hyperparameter_not_allowed', param FROM hp
WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.algorithm = hp.algorithm AND a.param = hp.param)""")
def q_request_audit(spark, sf_dir):
    return A.request_audit(training_requests(spark, sf_dir), allowed_params(spark))


@query("resolve_ground_truth", f"""
WITH s AS ({SCORING_REQUESTS_SQL}), cat AS ({CATALOGUE_SQL}),
c AS (SELECT s.*, CASE WHEN ground_truth_arg = '' THEN NULL WHEN ground_truth_arg IS NOT NULL THEN ground_truth_arg
                       WHEN EXISTS (SELECT 1 FROM cat WHERE cat.dataset_id = s.dataset_id AND cat.column_name = s.manifest_target)
                       THEN manifest_target END AS ground_truth FROM s)
SELECT request_id, ground_truth,
       CASE WHEN ground_truth IS NULL THEN 'disabled'
            WHEN list_contains(feature_columns, ground_truth) THEN 'ground_truth_is_feature'
            WHEN NOT EXISTS (SELECT 1 FROM cat WHERE cat.dataset_id = c.dataset_id AND cat.column_name = c.ground_truth)
            THEN 'ground_truth_not_found' ELSE 'ok' END AS status
FROM c""")
def q_resolve_ground_truth(spark, sf_dir):
    return A.resolve_ground_truth(scoring_requests(spark, sf_dir), column_catalogue(spark, sf_dir))


@query("ground_truth_candidates", f"""
WITH s AS ({SCORING_REQUESTS_SQL}), cat AS ({CATALOGUE_SQL}),
c AS (SELECT s.request_id, s.manifest_target, cat.position, cat.column_name FROM s JOIN cat ON cat.dataset_id = s.dataset_id
      WHERE NOT list_contains(s.feature_columns, cat.column_name))
SELECT request_id, count(*) AS candidate_count,
       coalesce(max(CASE WHEN column_name = manifest_target THEN column_name END), arg_max(column_name, position)) AS auto_detected
FROM c GROUP BY request_id""")
def q_ground_truth_candidates(spark, sf_dir):
    return A.ground_truth_candidates(scoring_requests(spark, sf_dir), column_catalogue(spark, sf_dir))
