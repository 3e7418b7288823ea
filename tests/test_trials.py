"""Search spaces, models and trials."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabgauge.functions.digest import uniform
from tabgauge.operators import encode, models, neighbours, search_space, split, trials
from tabgauge.plans import catalogue, trial_queries
from tabgauge.schema import STATUS_FAILED, STATUS_SUCCESS
from tabgauge.sources.datasets import as_dataset


def test_random_configs_are_distinct_and_start_with_the_default(spark):
    rows = search_space.random_configs(spark, "rf", n=30).orderBy("config_id").collect()
    assert [r["config_id"] for r in rows] == list(range(1, 32))
    assert rows[0]["values"]["max_depth"] == "None" and rows[0]["values"]["min_samples_leaf"] == "1"
    assert len({tuple(sorted(r["values"].items())) for r in rows}) == 31


@pytest.mark.parametrize("model", sorted(search_space.SPACES))
def test_draws_stay_in_range(spark, model):
    drawn = search_space.draw(spark.range(200).withColumnRenamed("id", "draw"), [model])
    space = search_space.space_table(spark, [model])
    joined = drawn.join(space.select("name", "kind", "lower", "upper", "choices", "default_value"), "name")
    number = F.col("value").cast("double")
    bad = joined.filter(
        F.when(F.col("kind") == "choice", ~F.array_contains("choices", F.col("value")))
        .when(F.col("kind") == "constant", F.col("value") != F.col("default_value"))
        .otherwise((number < F.col("lower")) | (number > F.col("upper")) | number.isNull())
    )
    assert bad.count() == 0 and drawn.count() == 200 * len(search_space.SPACES[model])


def test_space_report(spark):
    rows = {(r["model"], r["name"]): r for r in search_space.space_report(search_space.space_table(spark)).collect()}
    assert rows[("linear", "penalty")]["range"] == "{l2, None}" and rows[("rf", "min_samples_leaf")]["type"] == "UniformInt"


@pytest.fixture(scope="module")
def dataset(spark):
    rows = spark.range(400).select(
        "id", (uniform(1, "id") * 10).alias("a"), F.when(F.col("id") % 9 != 0, uniform(2, "id")).alias("b"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("c"),
    )
    labelled = rows.withColumn("y", F.when(F.col("a") + (F.col("c") == "odd").cast("int") * 3 > 6, "hi").otherwise("lo"))
    d = as_dataset(labelled, "id", "y")
    return d, split.stratified_splits(d.df, "id", "y", F.col("id") % 4)


STEPS = encode.Steps((encode.OneHotEncoder(("c",)), encode.MedianImputer(("b",)), encode.StandardScaler(("a", "b"))))


def _values(record):
    return dict(zip([f.name for f in trials.TRIAL_INFO.fields], record[2]))


@pytest.mark.parametrize("early_stop", [None, "validation", "training"])
def test_boosted_trial(dataset, early_stop):
    d, splits = dataset
    record, predictions = trials.run_trial(
        d, split.split_parts(splits, 0, 0), "xgb", {"n_estimators": 5}, STEPS, metrics=("accuracy", "roc_auc"), early_stop=early_stop, keep_predictions=True
    )
    info = _values(record)
    assert info["status"] == STATUS_SUCCESS, info["additional_info"]
    assert info["test_metrics"]["roc_auc"] > 0.9 and record[1] == pytest.approx(1 - info["valid_metrics"]["roc_auc"])
    assert predictions.filter("abs(probs[0] + probs[1] - 1) > 1e-9").count() == 0 and predictions.count() == 400


def test_failed_trial_is_a_record(dataset):
    d, splits = dataset
    record, _ = trials.run_trial(d, split.split_parts(splits, 0, 0), "no such model", {}, STEPS)
    info = _values(record)
    assert info["status"] == STATUS_FAILED and "unknown model" in info["additional_info"]["error"] and record[1] is None


def test_run_over_splits_and_fold(spark, dataset):
    d, splits = dataset
    records, mean = trials.run_over_splits(
        spark, d, splits, fold=1, n_splits=2, method="linear", config={"C": 1.0}, encoders=STEPS, metrics=("accuracy", "roc_auc")
    )
    rows, one = trials.trial_rows(records).collect(), mean.first()
    assert one["n_splits"] == 2
    assert one["test_metrics"]["roc_auc"] == pytest.approx(sum(r["test_metrics"]["roc_auc"] for r in rows) / 2)
    assert one["total_walltime"] == pytest.approx(sum(r["total_walltime"] for r in rows))


def test_refit_needs_exactly_one_config(spark, dataset):
    d, splits = dataset
    configs = spark.createDataFrame([(1, {"C": "1.0"}), (2, {}), (2, {})], "config_id int, values map<string,string>")
    record, _ = trials.refit(d, split.fold_parts(splits, 0), "linear", configs, encoders=STEPS, metrics=("accuracy", "roc_auc"))
    assert _values(record)["valid_metrics"] is None and _values(record)["test_metrics"]["accuracy"] > 0.8
    for bad in (2, 3):
        with pytest.raises(LookupError):
            trials.refit(d, split.fold_parts(splits, 0), "linear", configs, config_id=bad, encoders=STEPS)


def test_multiclass_boosting_gives_probabilities(spark):
    rows = spark.range(240).select((F.col("id") % 3).cast("double").alias("label"), ((F.col("id") % 3) * 2 + uniform(1, "id")).alias("x"))
    table = models.assemble(rows, ["x"])
    fitted = models.build("hgbt", {"n_estimators": 3}, {"n_rows": 240, "n_features": 1, "n_classes": 3, "seed": 1}).fit(table)
    out = models.predict_proba(fitted, table, 3)
    assert out.filter("abs(aggregate(probs, 0D, (a, v) -> a + v) - 1) > 1e-9 or size(probs) <> 3").count() == 0


def test_user_model(spark):
    from pyspark.ml.classification import NaiveBayes

    @models.model("bayes")
    def _(config, facts):
        return NaiveBayes()

    assert isinstance(models.build("bayes", {}, {}), NaiveBayes)
    del models.MODELS["bayes"]


def test_neighbours_against_brute_force(spark):
    import numpy as np

    df = spark.range(90).select("id", F.array(uniform(1, "id"), uniform(2, "id")).alias("v"), (F.col("id") % 3).cast("int").alias("label"))
    rows = df.orderBy("id").toPandas()
    points = np.stack(rows["v"])
    got = neighbours.nearest_neighbours(df.repartition(5), df, "id", "v", k=4, exclude_self=True).collect()
    assert len(got) == 90 * 4
    for r in got:
        d = np.sqrt(((points - points[r["id"]]) ** 2).sum(axis=1))
        d[r["id"]] = np.inf
        assert np.argsort(d, kind="stable")[r["rank"] - 1] == r["neighbour"] and d[r["neighbour"]] == pytest.approx(r["distance"])
    blocks = neighbours.nearest_neighbours(df, df, "id", "v", k=4, exclude_self=True, block_rows=7).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))


def test_neighbours_with_many_ties(spark):
    points = [(i, [float(i % 2), 0.0]) for i in range(400)]
    df = spark.createDataFrame(points, "id int, v array<double>")
    got = neighbours.nearest_neighbours(df, df, "id", "v", k=5, exclude_self=True, block_rows=64).collect()
    for r in got:
        assert r["distance"] == 0.0 and r["neighbour"] == [j for j in range(400) if j % 2 == r["id"] % 2 and j != r["id"]][r["rank"] - 1]
    assert len(got) == 2000


def test_classifier_is_fitted_on_a_bounded_sample(spark):
    df = spark.createDataFrame([(i, [float(i)], i % 3) for i in range(60)], "id int, v array<double>, y int")
    small = neighbours.knn_classify(df, df, "id", "v", "y", k=1, max_train=3).collect()
    assert len(small) == 60 and all(r["share"] == 1.0 for r in small)
    assert {r["id"]: r["prediction"] for r in neighbours.knn_classify(df, df, "id", "v", "y", k=1).collect()} == {i: i % 3 for i in range(60)}


def test_linear_steps_return_few_gradients(spark, monkeypatch):
    rows = spark.range(400, numPartitions=64).select(
        F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("v"), (F.col("id") % 3).cast("double").alias("label")
    )
    table = rows.select(array_to_vector("v").alias("features"), "label")
    seen, plain_fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or plain_fit(self, df, *a))
    est = models.build("linear", {"C": 1.0}, {"n_rows": 400, "n_features": 2, "n_classes": 3, "seed": 1})
    got = est.fit(table)
    assert seen == [min(64, 3 * spark.sparkContext.defaultParallelism)]
    want = LogisticRegression(regParam=1.0 / 400, maxIter=100).fit(table)
    assert np.allclose(got.coefficientMatrix.toArray(), want.coefficientMatrix.toArray(), atol=1e-6)
    wide = models.build("linear", {}, {"n_rows": 400, "n_features": 900_000, "n_classes": 3, "seed": 1})
    assert wide.tasks(12) == 12 and wide.estimator.getMaxBlockSizeInMB() > 4 * 21


def test_neighbour_shuffle_grows_with_the_tables():
    blocks = lambda n: 1 + (n - 1) // neighbours._block_rows(n)
    assert [blocks(n) for n in (1, 2_048, 2_049, 100_000, 600_000, 1_000_000)] == [1, 1, 2, 16, 16, 16]
    assert neighbours._block_rows(10**9) == neighbours.LARGEST_BLOCK_ROWS


@pytest.mark.parametrize("tile", [3, 7, 100])
def test_neighbour_tiles_leave_the_answer(monkeypatch, tile):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (50, 3)).astype("float32")  # many ties
    rows = pd.DataFrame({"id": np.arange(50), "v": list(x)})
    monkeypatch.setattr(neighbours, "TILE_ROWS", tile)
    got = neighbours._closest(4, "id", "v", None, True)(rows, rows)
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(axis=2))
    want = {i: sorted((d[i, j], j) for j in range(50) if j != i)[:4] for i in range(50)}
    for i, mine in got.groupby("id"):
        assert sorted(zip(mine["distance"], mine["neighbour"])) == want[i]


@pytest.mark.parametrize("fold", [0, 3])
def test_a_fold_dealt_alone_has_the_same_splits(spark, fold):
    df = spark.range(300).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("y"))
    deal = lambda **o: split.stratified_splits(df, "id", "y", F.col("id") % 4, **o)
    want = sorted(map(str, deal().filter(F.col("fold") == fold).collect()))
    assert sorted(map(str, deal(only=[fold]).collect())) == want and len(want) == 300


def test_a_trial_query_builds_its_rows_once(spark):
    built = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(k):
        built.add(1)
        return k

    rows = spark.range(200).select(counted("id").alias("row_key"), (F.col("id") % 9).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("label"))
    with trial_queries._dataset(rows, "label") as dataset:
        splits = split.stratified_splits(dataset.df, "row_key", "label", F.col("row_key") % 4, only=[0])
        steps = encode.Steps((encode.StandardScaler(("a",)),))
        record, _ = trials.run_trial(dataset, split.split_parts(splits, 0, 0), "linear", {"C": 1.0}, steps)
    assert record[2][0] == 1 and built.value == 200


@pytest.fixture(scope="module")
def trial_tables(spark, tmp_path_factory):
    """Writes the tables of the trial queries, 240 orders of one line each; the order ``no_price`` has no price."""

    def written(name, keys="id", no_price=-1):
        to = str(tmp_path_factory.mktemp(name))
        key = F.expr(keys)
        price = F.when(key != no_price, 100_000.0 + 500.0 * (F.col("id") % 240))
        tables = {
            "lineitem": (key.alias("l_orderkey"), price.alias("l_extendedprice"), ((F.col("id") % 11) / 100).alias("l_discount"),
                         F.when(F.col("id") % 3 == 0, "A").otherwise("N").alias("l_returnflag")),
            "orders": (key.alias("o_orderkey"), F.concat((F.col("id") % 5).cast("string"), F.lit("-LOW")).alias("o_orderpriority"),
                       (F.col("id") % 20).alias("o_custkey"), F.when(F.col("id") % 2 == 0, "O").otherwise("F").alias("o_orderstatus"),
                       price.alias("o_totalprice"), F.lit("1995-01-01").cast("date").alias("o_orderdate")),
            "customer": ((F.col("id") % 20).alias("c_custkey"), F.lit(1.0).alias("c_acctbal"), F.lit("TOYS").alias("c_mktsegment"),
                         F.concat(F.lit("c"), F.col("id") % 20).alias("c_name")),
        }
        for table, columns in tables.items():
            rows = spark.range(20 if table == "customer" else 240)
            rows.select(*columns).write.parquet(f"{to}/{table}.parquet")
        return to

    return written


@pytest.mark.parametrize(
    "name",
    ["trial_forest", "trial_linear", "refit_linear", "trial_linear_one_hot", "trial_perceptron", "trial_tree_balanced", "trial_boosted", "trial_linear_svm"],
)
def test_a_failed_trial_fails_its_query(spark, trial_tables, monkeypatch, name):
    def broken(*_):
        raise MemoryError("no memory for the fit")

    monkeypatch.setattr(models, "build", broken)
    with pytest.raises(MemoryError, match="no memory for the fit"):
        catalogue.callables()[name](spark, trial_tables(name)).collect()


def test_rows_that_no_model_takes_fail_the_query(spark, trial_tables):
    with pytest.raises(Exception, match="VectorAssembler"):
        catalogue.callables()["trial_forest"](spark, trial_tables("no_price", no_price=7)).collect()


def test_a_part_without_rows_leaves_the_scores_of_the_others(spark, trial_tables):
    rows = catalogue.callables()["trial_forest"](spark, trial_tables("no_test", keys="4 * id + 1")).collect()
    assert {r["part"] for r in rows} == {"train", "valid"} and len(rows) == 6 and all(r["status"] == STATUS_SUCCESS for r in rows)
