"""Command line: extract, train, detect, evaluate, label, rank.

Run as ``python -m aircadence.cli COMMAND --help``.  Tables are Parquet unless
a path ends in ``.csv``.
"""

from __future__ import annotations

import argparse
import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from aircadence import schema as S
from aircadence.functions import frames as X
from aircadence.ml import forests, metrics, models, prep
from aircadence.operators import flows, labels, windows
from aircadence.sources import pcap, readers
from aircadence.sources.capture_index import read_captures
from aircadence.workspace import Workspace


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)


def _write(rows: DataFrame, path: str) -> None:
    readers.write_features(rows, path, "csv" if path.endswith(".csv") else "parquet")


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    frames = X.head_per_file(read_captures(spark, a.input), a.max_frames)
    features = X.frame_features(frames)
    out = flows.flow_burst_features(flows.sessionise(features, a.flow_timeout, a.burst_threshold), a.min_burst)
    _write(labels.label_files(out, readers.read_labels(spark, a.labels)) if a.labels else out, a.output)
    if a.windows:
        _write(windows.window_features(features, a.window), a.windows)


def _prepared(rows: DataFrame, columns: list[str], fitted: dict) -> DataFrame:
    filled = prep.impute(prep.align(rows, columns), columns, dict.fromkeys(columns, 0.0))
    return models.assembled(prep.scale(filled, fitted), columns)


def _ready(rows: DataFrame, a: argparse.Namespace) -> tuple[DataFrame, list[str], list[str], dict]:
    """Labelled rows as scaled vectors with ``is_test`` and ``fold``; columns, class names and scaling."""
    rows = rows.where(F.col(a.label).isNotNull())
    if a.binary:
        # The positive class comes second, so it has index 1.
        rows = rows.withColumn(a.label, F.when(F.col(a.label) == a.binary, f"1 {a.binary}").otherwise(f"0 non_{a.binary}"))
    columns = prep.feature_columns(rows, [a.label])
    key = F.xxhash64(*columns).bitwiseAND(F.lit((1 << 31) - 1))
    rows = prep.stratified_split(rows.withColumn("__key", key), a.label, "__key")
    # Imputation and scaling are fitted on the training rows alone.
    filled = prep.impute(rows, columns, prep.medians(rows.where("not is_test"), columns))
    fitted = prep.scaling(filled.where("not is_test"), columns)
    ready = prep.class_weights(prep.encode_labels(models.assembled(prep.scale(filled, fitted), columns), a.label), a.label)
    ready = prep.stratified_folds(ready.withColumn("label_index", F.col("label_index").cast("double")), a.label, "__key", a.folds)
    ready = Workspace(rows.sparkSession, "train").stage(ready, "ready")
    names = [r[0] for r in ready.select(a.label, "label_index").distinct().orderBy("label_index").collect()]
    return ready, columns, [n.split(" ", 1)[1] for n in names] if a.binary else names, fitted


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    """Train SVM, forest and ensemble, report them, and save each and the best."""
    ready, columns, names, fitted = _ready(_read(spark, a.input), a)
    fitting, testing = ready.where("not is_test"), ready.where("is_test")
    dims, kinds = len(columns), ("svm", "rf")
    fits = {"svm": lambda rows, **how: models.fit_kernel_svm(rows, dims, **how), "rf": models.fit_forest}
    metric = "f1" if a.binary else "f1_weighted"
    fitted_models: dict[str, object] = {}
    chosen: dict[str, dict] = {"svm": {}, "rf": {}}
    if a.search:
        fitted_models["svm"], chosen["svm"], _ = models.search(fitting, fits["svm"], models.SVM_GRID_BINARY if a.binary else models.SVM_GRID, a.folds, metric=metric)
        fitted_models["rf"], chosen["rf"], _ = forests.forest_search(fitting, models.FOREST_GRID_BINARY if a.binary else models.FOREST_GRID, a.folds, metric=metric)
        print(f"svm: {chosen['svm']}, rf: {chosen['rf']}")
    else:
        fitted_models = {name: fits[name](fitting) for name in kinds}
    weights = (1.0, 1.0)
    if a.weigh:
        # Weights are chosen on rows that the members have not seen: a fold is kept from both.
        seen, unseen = fitting.where("fold <> 0"), fitting.where("fold = 0")
        svm = fits["svm"](seen, **chosen["svm"])
        rf = forests.grow(seen, chosen["rf"]["trees"], chosen["rf"]["depth"], chosen["rf"]["leaf"]) if a.search else fits["rf"](seen)
        if a.search:
            rf.split = chosen["rf"]["split"]
        both = models.predictions(rf, models.predictions(svm, unseen, "p1"), "p2")
        weights, _ = metrics.best_weights(metrics.weight_search(both, "label_index", "p1", "p2", metric="f1_weighted"))
    fitted_models["ensemble"] = models.Vote({n: fitted_models[n] for n in kinds}, tuple(map(float, weights)))
    told = {n: m.transform(testing).select(F.col("label_index").alias("y_true"), F.col("prediction").alias("y_pred")) for n, m in fitted_models.items()}
    if a.binary:
        f1 = {n: metrics.binary_detection(t).first().f1 for n, t in told.items()}
        for n, t in told.items():
            metrics.binary_detection(t).withColumn("model", F.lit(n)).show(truncate=False)
    else:
        compared = models.compare_models(told)
        compared.show(truncate=False)
        f1 = {r.model: r.f1_weighted for r in compared.collect()}
    best = models.choose_model(f1)
    print(f"best: {best}")
    scaling = spark.createDataFrame([(c, m, s) for c, (m, s) in fitted.items()], "feature string, mean double, std double").coalesce(1)
    for name, where in (*((n, f"{a.output}/all/{n}") for n in fitted_models), (best, a.output)):
        models.save_bundle(fitted_models[name], where, columns, names, name)
        scaling.write.mode("overwrite").parquet(f"{where}/scaling")


def predict(spark: SparkSession, rows: DataFrame, bundle: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with the columns of ``keep`` and ``predicted_type``, ``confidence`` and a column per class."""
    model, meta = models.load_bundle(spark, bundle)
    fitted = {r.feature: (r["mean"], r["std"]) for r in spark.read.parquet(f"{bundle}/scaling").collect()}
    names = F.array(*map(F.lit, meta["label_names"]))
    told = models.predictions(model, _prepared(rows, meta["feature_names"], fitted), "p")
    told = told.withColumn("predicted_type", F.element_at(names, (metrics.argmax(F.col("p")) + 1).cast("int"))).withColumn("confidence", F.array_max("p"))
    return told.select(*(c for c in ("source_file", "sa", "da", "flow_id", "device_type", *keep) if c in rows.columns), "predicted_type", "confidence", *(F.col("p")[i].alias(f"prob_{n}") for i, n in enumerate(meta["label_names"])))


def detect(spark: SparkSession, a: argparse.Namespace) -> None:
    told = predict(spark, _read(spark, a.input), a.model)
    _write(told, a.output)
    told.where(F.col("confidence") >= a.min_confidence).groupBy("predicted_type").count().orderBy(F.desc("count")).show()
    if a.alert:
        models.alerts(told, a.alert, a.min_confidence).select("sa", "da", "confidence").show(50, truncate=False)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Metrics, confusion, curves of each class and, with folds, cross-validation as JSON files."""
    rows = _read(spark, a.input).where(F.col(a.label).isNotNull())
    names = models.load_bundle(spark, a.model)[1]["label_names"]
    kept = predict(spark, rows.withColumn("__truth", F.col(a.label)), a.model, ["__truth"])
    told = kept.select(F.col("__truth").alias("y_true"), F.col("predicted_type").alias("y_pred"))
    readers.write_evaluation(metrics.overall_metrics(told), f"{a.output}/overall.json")
    readers.write_evaluation(metrics.class_metrics(told), f"{a.output}/classes.json")
    readers.write_evaluation(metrics.confusion_matrix(told), f"{a.output}/confusion.json")
    index = F.array_position(F.array(*map(F.lit, names)), F.col("__truth")) - 1
    each = metrics.one_vs_rest(kept.select(index.alias("y"), F.array(*(F.col(f"prob_{n}") for n in names)).alias("p")), "y", "p", names)
    readers.write_evaluation(metrics.roc_auc(each, ["label"]).where("auc is not null"), f"{a.output}/auc.json")
    readers.write_evaluation(metrics.roc_curve(each, ["label"]), f"{a.output}/roc.json")
    readers.write_evaluation(metrics.pr_curve(each, ["label"]), f"{a.output}/pr.json")
    if a.folds:
        ready, columns, _, _ = _ready(rows, a)
        fit = models.fit_forest if a.kind == "rf" else lambda r: models.fit_kernel_svm(r, len(columns))
        readers.write_evaluation(models.cross_scores(ready, fit, a.folds), f"{a.output}/folds.json")


def label(spark: SparkSession, a: argparse.Namespace) -> None:
    now = datetime.datetime.now().isoformat()
    row = spark.createDataFrame([(a.mac.strip().lower(), a.type, a.session, a.notes, now)], readers.LABEL_SCHEMA)
    readers.append_labels(row, a.output)


def rank(spark: SparkSession, a: argparse.Namespace) -> None:
    windows.source_ranking(read_captures(spark, a.input), a.top).show(a.top, truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="aircadence")
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, *options: tuple[str, dict]) -> None:
        c = sub.add_parser(f.__name__, help=(f.__doc__ or "").split("\n")[0])
        c.set_defaults(run=f)
        for name, how in options:
            c.add_argument(name, **how)

    need, source, target = {"required": True}, ("--input", {"required": True}), ("--output", {"required": True})
    command(extract, source, target, ("--labels", {}), ("--windows", {}), ("--max-frames", {"type": int}), ("--flow-timeout", {"type": float, "default": 5.0}), ("--burst-threshold", {"type": float, "default": 1.0}), ("--min-burst", {"type": int, "default": 3}), ("--window", {"type": float, "default": 10.0}))
    command(train, source, target, ("--label", {"default": "device_type"}), ("--binary", {}), ("--search", {"action": "store_true"}), ("--weigh", {"action": "store_true"}), ("--folds", {"type": int, "default": 5}))
    command(detect, source, target, ("--model", need), ("--alert", {}), ("--min-confidence", {"type": float, "default": 0.5}))
    command(evaluate, source, target, ("--model", need), ("--label", {"default": "device_type"}), ("--binary", {}), ("--folds", {"type": int, "default": 0}), ("--kind", {"choices": ("rf", "svm"), "default": "rf"}))
    command(label, target, ("--mac", need), ("--type", {"required": True, "choices": S.DEVICE_TYPES}), ("--session", need), ("--notes", {"default": ""}))
    command(rank, source, ("--top", {"type": int, "default": 10}))
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("aircadence").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    pcap.register(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
