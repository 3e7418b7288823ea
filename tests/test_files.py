"""Files written and read back: run records, result CSVs, splits, predictions, logs, and the incremental reader."""

import json

import pytest
from pyspark.sql import functions as F

from tabgauge.operators import split, trials
from tabgauge.sources import run_records, tables
from tabgauge.streaming.run_ingest import ingest_new_results


def _run(root, method, task, fold, split_id, config, info, metrics=("acc",), categorical=()):
    folder = root / method / f"task_{task}" / f"fold_{fold}" / f"split_{split_id}" / f"config_{config}"
    folder.mkdir(parents=True)
    record = {
        "run_config": {"model_name": method, "task_id": task, "fold_number": fold, "split_id": split_id, "config_id": config, "additional_metrics": list(metrics)},
        "result": [0.25, {"status": 1, "total_walltime": 12.0, "average_split_fit_time": 3.0, "additional_info": {}, **info}],
        "additional_info": {"dataset_properties": {"categorical_columns": list(categorical)}},
    }
    (folder / "result.json").write_text(json.dumps(record, indent=2))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "exp"
    good = {"valid_metrics": {"acc": 0.9, "other": 0.1}, "test_metrics": {"acc": 0.8}, "train_metrics": None, "additional_info": {"num_params": 42, "best_iter": 7}}
    _run(root, "rf", 11, 0, 0, 1, good, categorical=["a"])
    _run(root, "rf", 11, 1, 2, 5, {"status": 2, "additional_info": {"error": "boom"}})
    _run(root, "xgb", 12, 0, 1, 2, {"test_metrics": {"acc": float("nan")}})
    (root / "xgb" / "notes.json").write_text("{}")
    broken = root / "rf" / "task_11" / "fold_0" / "split_0" / "config_9"
    broken.mkdir(parents=True)
    (broken / "result.json").write_text('{"run_config": {"model_na')
    return root


def test_scan_and_flatten(spark, tree):
    records = run_records.read_run_records(spark, str(tree))
    assert {(r["method"], r["task_id"], r["fold"], r["split"], r["config"]) for r in records.collect()} == {
        ("rf", 11, 0, 0, 1), ("rf", 11, 1, 2, 5), ("xgb", 12, 0, 1, 2)
    }
    cells = {(r["method"], r["config"], r["metric"]): r["value"] for r in run_records.flatten_records(records).collect()}
    assert cells[("rf", 1, "valid_acc")] == 0.9 and cells[("rf", 1, "test_acc")] == 0.8
    assert ("rf", 1, "train_acc") not in cells and ("rf", 1, "valid_other") not in cells
    assert cells[("rf", 1, "num_params")] == 42 and cells[("rf", 1, "best_iteration")] == 7
    assert cells[("rf", 5, "total_walltime")] == -8640 and cells[("rf", 1, "total_walltime")] == 12
    assert ("xgb", 2, "test_acc") not in cells
    assert run_records.read_run_records(spark, str(tree), max_folds=1, max_splits=1).count() == 1


def test_resume_rules(spark, tree):
    log = run_records.trial_log(run_records.read_run_records(spark, str(tree)))
    grid = log.select(*trials.TRIAL_KEYS).unionByName(
        spark.createDataFrame([("rf", 99, 0, 0, 1)], "method string, task_id bigint, fold int, split int, config int")
    )
    left = lambda **k: {(r["method"], r["task_id"], r["config"]) for r in trials.pending_trials(grid, log, **k).collect()}
    assert left() == {("rf", 99, 1)}
    assert left(cat_overwrite=True) == {("rf", 99, 1), ("rf", 11, 1)}
    assert len(left(overwrite=True)) == 4


def test_write_and_read_records(spark, tree, tmp_path):
    records = run_records.read_run_records(spark, str(tree))
    run_records.write_run_records(records, str(tmp_path / "out"))
    again = run_records.read_run_records(spark, str(tmp_path / "out"))
    a = run_records.flatten_records(records).collect()
    b = run_records.flatten_records(again).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    layout = {p.parent.relative_to(tmp_path / "out").parts[1] for p in (tmp_path / "out").rglob("*.json")}
    assert layout == {"task=task_11", "task=task_12"}


def test_incremental_ingest(spark, tree, tmp_path):
    out, mark = str(tmp_path / "facts"), str(tmp_path / "mark")
    ingest_new_results(spark, str(tree), out, mark)
    first = spark.read.parquet(out).count()
    _run(tree, "rf", 13, 0, 0, 1, {"valid_metrics": {"acc": 0.5}})
    ingest_new_results(spark, str(tree), out, mark)
    facts = spark.read.parquet(out)
    batch = run_records.flatten_records(run_records.read_run_records(spark, str(tree)))
    assert facts.count() > first
    cols = ["method", "task_id", "fold", "split", "config", "metric", "value"]
    assert sorted(map(tuple, facts.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_results_csv_round_trip(spark, tmp_path):
    rows = [("rf", 0, 1, 2, "valid_x", 11, 0.5), ("rf", 0, 1, 2, "test_x", 11, 0.25), ("gb", 3, 0, 1, "test_x", 12, 1.5)]
    facts = spark.createDataFrame(rows, "method string, fold int, split int, config int, metric string, task_id bigint, value double")
    path = str(tmp_path / "results.csv")
    tables.write_results_csv(facts, path)
    back = tables.read_results_csv(spark, path)
    assert sorted(map(tuple, back.select(*facts.columns).collect())) == sorted(rows)


def test_results_csv_of_many_parts_and_columns(spark, tmp_path):
    """Several part files, quoted names, a metric with two underscores, gaps, and 30,000 columns."""
    odd = 'a "b", c'
    rows = [(m, f, 0, c, "valid__x", t, t + f / 4 + c / 8) for m in ("rf", odd) for f in range(5) for c in range(4) for t in range(f, 40, 3)]
    rows += [(odd, 9, 1, 1, "wide", t, 0.5 - t) for t in range(30_000)] + [("rf", 9, 1, 1, "wide", 29_999, 1e-9)]
    schema = "method string, fold int, split int, config int, metric string, task_id bigint, value double"
    facts = spark.createDataFrame(rows, schema).repartition(4)
    gaps = spark.createDataFrame([("rf", 0, 0, 0, "valid__x", 1, None), ("rf", 0, 0, 0, "none", 1, float("nan"))], schema)
    path = str(tmp_path / "results.csv")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_results_csv(facts.unionByName(gaps), path)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "results.csv" / "rows").glob("part-*"))) >= 4
    back = tables.read_results_csv(spark, path).select(*facts.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    some = tables.read_results_csv(spark, path, metrics=["valid__x"], tasks=[3, 4]).select(*facts.columns)
    assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if r[4] == "valid__x" and r[5] in (3, 4))


def test_pandas_style_csv_with_two_index_columns(spark, tmp_path):
    (tmp_path / "rf").mkdir()
    (tmp_path / "rf" / "results.csv").write_text("metric,,test_x,test_x,valid_x\ntask_id,,11,12,11\nmethod,fold,,,\nrf,0,0.5,,0.7\nrf,1,0.6,0.1,\n")
    got = {(r["fold"], r["metric"], r["task_id"]): r["value"] for r in tables.load_results(spark, str(tmp_path), ["rf"]).collect()}
    assert got == {(0, "test_x", 11): 0.5, (0, "valid_x", 11): 0.7, (1, "test_x", 11): 0.6, (1, "test_x", 12): 0.1}
    assert tables.load_results(spark, str(tmp_path), ["rf"], tasks=[12]).count() == 1


def test_split_table_is_appended_once(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"))
    s = split.stratified_splits(df, "k", "y", F.col("k") % 4)
    path = str(tmp_path / "splits")
    assert tables.write_splits(s.withColumn("task_id", F.lit(1)), path) == 1
    two = s.withColumn("task_id", F.explode(F.array(F.lit(1), F.lit(2))))
    assert tables.write_splits(two, path) == 1
    assert spark.read.parquet(path).count() == 2 * s.count()
    one = tables.read_splits(spark, path, 2, fold=1)
    assert one.count() == 40
    lists = tables.split_key_lists(s, key_range=8)
    assert lists.agg(F.max("piece")).first()[0] > 0
    assert lists.agg(F.sum(F.size("keys"))).first()[0] == 40 * 4 * 5


def test_predictions_and_logs(spark, tmp_path):
    p = spark.createDataFrame([("train", 1, 0, [0.9, 0.1]), ("test", 2, 1, [0.2, 0.8])], "part string, row_key int, y int, probs array<double>")
    tables.write_predictions(p, str(tmp_path / "p"))
    back = tables.read_predictions(spark, str(tmp_path / "p"))
    assert {r["row_key"]: r["row"] for r in tables.truth_and_probs(back).collect()} == {1: [0.0, 0.9, 0.1], 2: [1.0, 0.2, 0.8]}
    log = spark.createDataFrame([("m", 0.5)], "name string, loss double")
    tables.append_log(log, str(tmp_path / "log"))
    tables.append_log(log, str(tmp_path / "log"))
    assert tables.read_log(spark, str(tmp_path / "log"), "name string, loss double").count() == 2


def test_config_table(spark, tmp_path):
    (tmp_path / "configs.json").write_text(json.dumps({"1": {"max_depth": "None", "n": 3}, "2": {"max_depth": "4", "n": 5}}, indent=4))
    got = {r["config_id"]: (r["model"], r["values"]) for r in run_records.read_config_table(spark, str(tmp_path / "configs.json"), "xgb_early_stop_valid").collect()}
    assert got == {1: ("xgb", {"max_depth": None, "n": "3"}), 2: ("xgb", {"max_depth": "4", "n": "5"})}


def test_table_text(spark):
    df = spark.createDataFrame([("a", 1)], "name string, n int")
    assert tables.table_text(df, ["name", "n"], "markdown").first()["line"] == "| a | 1 |"
    assert tables.table_head(["name", "n"], "markdown") == ["| name | n |", "|---|---|"]
    tables_dir = tables.table_text(df, ["name", "n"])
    assert tables_dir.first()["line"] == "a & 1 \\\\"
