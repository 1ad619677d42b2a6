"""Guards stop a scoring run where its predictions are read."""

import pytest

from tessera.operators.score import FeatureSpec, LinearModel, Manifest, score

MANIFEST = Manifest(id="m", name="m", features=(FeatureSpec("x", "float64"),), target="y")
MODEL = LinearModel(1.0, {"x": 2.0})


@pytest.mark.parametrize("truth", ["", None])
def test_predictions_of_an_empty_or_incomplete_input_raise(spark, truth):
    empty = spark.createDataFrame([], "x double, y double")
    gaps = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double").repartition(3)
    for df, what in ((empty, "at least one data row"), (gaps, "no rows left")):
        result = score(df, MANIFEST, MODEL, ground_truth=truth)
        with pytest.raises(Exception, match=what):
            result.predictions.collect()
        with pytest.raises(Exception, match=what):
            result.predictions.write.format("noop").mode("overwrite").save()


def test_predictions_of_other_inputs_are_whole(spark):
    rows = [(None, 1.0)] * 50 + [(float(i), 2.0) for i in range(20)]
    out = score(spark.createDataFrame(rows, "x double, y double").repartition(7), MANIFEST, MODEL).predictions
    assert sorted(r.prediction for r in out.collect()) == [1.0 + 2.0 * i for i in range(20)]
    assert out.count() == 20
