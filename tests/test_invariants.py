"""Invariants and the reference's API behaviours restated as table assertions."""
import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import retry_delay, source_name, valid_request_id
from tessera.operators import metrics as M
from tessera.operators.folds import kfold_assign, stratified_kfold_assign
from tessera.operators.score import FeatureSpec, LinearModel, Manifest, ValidationError, score
from tessera.plans.fixtures import table

from conftest import SF_MID, SF_SMALL

HOUSE = Manifest(id="house", name="House", target="Price",
                 features=(FeatureSpec("Area", "float64"), FeatureSpec("Room", "int64"), FeatureSpec("Age", "int64")))
HOUSE_MODEL = LinearModel(10.0, {"Area": 0.123456, "Room": 5.0, "Age": -1.0})


def test_fold_sizes_and_coverage(spark):
    o = table(spark, SF_MID, "orders")
    f = kfold_assign(o, ["o_orderkey"], k=5)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == o.count()
    assert f.select("o_orderkey").distinct().count() == o.count()


def test_stratified_folds_balanced_per_class(spark):
    o = table(spark, SF_MID, "orders")
    f = stratified_kfold_assign(o, ["o_orderkey"], "o_orderstatus", k=4)
    for r in f.groupBy("o_orderstatus").agg(F.min("fold").alias("a")).collect():
        assert r["a"] == 0
    per = f.groupBy("o_orderstatus", "fold").count().groupBy("o_orderstatus").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in per)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_folds_do_not_depend_on_partitioning(spark, parts):
    o = table(spark, SF_SMALL, "orders")
    base = {r[0]: r[1] for r in kfold_assign(o, ["o_orderkey"]).select("o_orderkey", "fold").collect()}
    other = {r[0]: r[1] for r in kfold_assign(o.repartition(parts), ["o_orderkey"]).select("o_orderkey", "fold").collect()}
    assert base == other


def test_kept_plus_dropped_is_input(spark):
    df = spark.createDataFrame([(1.0, 2, 3, 10.0), (None, 2, 3, 11.0), (2.0, 1, 1, None)], "Area double, Room long, Age long, Price double")
    res = score(df, HOUSE, HOUSE_MODEL)
    m = res.metrics.first()
    assert m["rows"] == 1 and m["dropped_rows"] == 2
    assert res.predictions.count() == 1


def test_missing_required_column_names_it(spark):
    df = spark.createDataFrame([(1.0, 2)], "Area double, Room long")
    with pytest.raises(ValidationError, match="Age"):
        score(df, HOUSE, HOUSE_MODEL)


def test_ground_truth_off_switch_and_auto_detect(spark):
    df = spark.createDataFrame([(100.0, 2, 3, 50.0)], "Area double, Room long, Age long, Price double")
    off = score(df, HOUSE, HOUSE_MODEL, ground_truth="")
    assert off.metrics is None and "prediction_error" not in off.predictions.columns
    auto = score(df, HOUSE, HOUSE_MODEL)
    assert auto.ground_truth == "Price" and "prediction_error" in auto.predictions.columns


def test_ground_truth_cannot_be_feature(spark):
    df = spark.createDataFrame([(100.0, 2, 3)], "Area double, Room long, Age long")
    with pytest.raises(ValidationError):
        score(df, HOUSE, HOUSE_MODEL, ground_truth="Area")


def test_rounding_to_four_decimals(spark):
    df = spark.createDataFrame([(1.1111, 1, 1, 3.0), (2.2222, 2, 2, 4.0)], "Area double, Room long, Age long, Price double")
    for r in score(df, HOUSE, HOUSE_MODEL).predictions.collect():
        for v in (r["prediction"], r["prediction_error"]):
            assert round(v, 4) == v


def test_non_numeric_feature_fails_inside_the_job(spark):
    df = spark.createDataFrame([("abc", "1", "2", "3")], "Area string, Room string, Age string, Price string")
    with pytest.raises(Exception, match="must contain"):
        score(df, HOUSE, HOUSE_MODEL).metrics.collect()


def test_int_feature_truncates_toward_zero(spark):
    from tessera.operators.score import coerce_features
    df = spark.createDataFrame([("1.7", "-1.7")], "Room string, Age string")
    r = coerce_features(df, HOUSE).first()
    assert r["Room"] == 1 and r["Age"] == -1


def test_retry_backoff_is_capped(spark):
    df = spark.createDataFrame([(1,), (3,), (5,)], "a int")
    got = [r[0] for r in df.select(retry_delay(F.col("a"), 2.0, 10.0)).orderBy(F.col("a")).collect()]
    assert sorted(got) == [2.0, 8.0, 10.0]


def test_source_name_and_request_id(spark):
    df = spark.createDataFrame([("C:\\a\\b\\x.csv",), ("dir/y.csv",), (None,)], "s string")
    assert [r[0] for r in df.select(source_name(F.col("s"))).collect()] == ["x.csv", "y.csv", "json-api"]
    ids = spark.createDataFrame([("abc-1_2.3",), ("a b",), ("x" * 129,)], "s string")
    assert [r[0] for r in ids.select(valid_request_id(F.col("s"))).collect()] == [True, False, False]


def test_weighted_prf_and_zero_division(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    m = M.classification_metrics(df, "y", "p").first()
    assert m["accuracy"] == 0.5
    # class a: p=1, r=.5; b: p=1/3, r=1; c: p=0 (never predicted), r=0; weights 2,1,1
    assert m["precision"] == round((2 * 1 + 1 / 3) / 4, 6)
    assert m["recall"] == round((2 * 0.5 + 1) / 4, 6)


def test_r2_constant_target_and_pearson_fallback(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    m = M.regression_metrics(df, "y", "p").first()
    assert m["r2"] == 1.0 and m["pearson_r"] == 0.0


def test_roc_auc_ties_average_rank(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.35), (1, 0.8), (0, 0.4)], "y int, s double")
    # pairs (pos, neg): 0.4 beats 0.1 and 0.35, ties 0.4; 0.8 beats all three -> 5.5 / 6
    assert M.roc_auc(df, "y", "s").first()[0] == round(5.5 / 6, 6)


def test_registry_disable_removes_from_active_only(spark):
    from tessera.operators import registry as G
    ev = spark.createDataFrame([
        ("m1", 1, "register", "One", None), ("m2", 2, "register", "Two", None),
        ("m3", 3, "register", "Three", None), ("m2", 4, "set_status", None, "disabled")],
        "model_id string, seq long, kind string, name string, status string")
    st = G.registry_state(ev)
    assert sorted(r[0] for r in G.active_models(st).select("model_id").collect()) == ["m1", "m3"]
    assert {r["model_id"]: r["status"] for r in G.registry_list(st).collect()}["m2"] == "disabled"


def test_history_newest_first(spark):
    from tessera.sources.store import newest_first
    df = spark.createDataFrame([("a", "2026-08-09 10:00:00"), ("b", "2026-08-10 10:00:00")], "id string, created_at string")
    assert [r[0] for r in newest_first(df, "created_at", "id").collect()] == ["b", "a"]


def test_rank_with_copies_hot_group(spark):
    """A third of the rows are copies of one key: every row still gets its own rank,
    the ranks are 1..n, and folds stay balanced."""
    from tessera.operators.ranking import global_rank_with_copies
    base = spark.range(0, 600).select((F.col("id") % 200).alias("k"), F.col("id").alias("v"))
    hot = spark.range(0, 400).select(F.lit(7).cast("long").alias("k"), F.lit(-1).cast("long").alias("v"))
    df = base.unionByName(hot).repartition(5)
    r = global_rank_with_copies(df, ["k", "v"], strata=None).cache()
    n = df.count()
    got = r.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.count("*")).first()
    assert tuple(got) == (1, n, n, n)
    folds = r.withColumn("fold", (F.col("rank") - 1) % 5).groupBy("fold").count().collect()
    sizes = [x["count"] for x in folds]
    assert max(sizes) - min(sizes) <= 1


def test_rank_with_copies_equals_rank_for_unique_keys(spark):
    from tessera.operators.ranking import global_rank, global_rank_with_copies
    o = table(spark, SF_SMALL, "orders").select("o_orderkey", "o_orderstatus")
    a = {r[0]: r[1] for r in global_rank(o, ["o_orderkey"], strata=["o_orderstatus"]).select("o_orderkey", "rank").collect()}
    b = {r[0]: r[1] for r in global_rank_with_copies(o, ["o_orderkey"], strata=["o_orderstatus"]).select("o_orderkey", "rank").collect()}
    assert a == b
