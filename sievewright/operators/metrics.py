"""Classification metrics and the analysis of training histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CLASSES, LABEL_INDEX, POSITIVE_CLASS
from ..functions.arrays import safe_divide


def _classes(spark, k: int) -> DataFrame:
    return spark.range(k).select(F.col("id").cast("int").alias("index"))


def confusion(rows: DataFrame, k: int = len(CLASSES)) -> DataFrame:
    """(actual, predicted, n): every cell of the k by k matrix; pairs outside it are not in it."""
    spark = rows.sparkSession
    grid = _classes(spark, k).select(F.col("index").alias("actual")).crossJoin(_classes(spark, k).select(F.col("index").alias("predicted")))
    inside = rows.where(F.col("actual").between(0, k - 1) & F.col("predicted").between(0, k - 1))
    have = inside.groupBy(F.col("actual").cast("int").alias("actual"), F.col("predicted").cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(have, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(rows: DataFrame, k: int = len(CLASSES)) -> DataFrame:
    """(index, precision, recall, f1, support); a zero denominator gives 0."""
    cells = confusion(rows, k)
    spread = cells.select(F.explode(F.array(F.struct(F.col("actual").alias("index"), F.lit("a").alias("side")), F.struct(F.col("predicted").alias("index"), F.lit("p").alias("side")))).alias("x"), "actual", "predicted", "n")
    on = F.when((F.col("x.side") == "a") & (F.col("actual") == F.col("predicted")), F.col("n")).otherwise(F.lit(0))
    sums = spread.groupBy(F.col("x.index").alias("index")).agg(
        F.sum(on).alias("tp"),
        F.sum(F.when(F.col("x.side") == "a", F.col("n")).otherwise(F.lit(0))).alias("support"),
        F.sum(F.when(F.col("x.side") == "p", F.col("n")).otherwise(F.lit(0))).alias("called"),
    )
    precision, recall = safe_divide(F.col("tp"), F.col("called")), safe_divide(F.col("tp"), F.col("support"))
    out = sums.select("index", precision.alias("precision"), recall.alias("recall"), "support")
    f1 = safe_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("index", "precision", "recall", f1.alias("f1"), "support")


def overall(rows: DataFrame, k: int = len(CLASSES)) -> DataFrame:
    """Accuracy over all rows, those outside the matrix included, and unweighted means over all k classes."""
    right = rows.agg(F.count("*").alias("num_samples"), F.count_if(F.col("actual") == F.col("predicted")).alias("right"))
    means = per_class(rows, k).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    return right.crossJoin(means).select("num_samples", safe_divide(F.col("right"), F.col("num_samples")).alias("accuracy"), "macro_precision", "macro_recall", "macro_f1")


def positive_class(rows: DataFrame) -> DataFrame:
    return per_class(rows).where(F.col("index") == LABEL_INDEX[POSITIVE_CLASS]).select(F.lit(POSITIVE_CLASS).alias("positive_class"), "precision", "recall", "f1", "support")


def metrics_report(rows: DataFrame) -> DataFrame:
    """One row with the nested report: matrix, per class, macro and positive class."""
    names = F.create_map(*(F.lit(x) for c, i in LABEL_INDEX.items() for x in (i, c)))
    stats = per_class(rows).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.element_at(names, F.col("index")).alias("k"), F.struct("precision", "recall", "f1", "support").alias("v"))))).alias("per_class"))
    matrix = confusion(rows).groupBy("actual").agg(F.sort_array(F.collect_list(F.struct("predicted", "n"))).alias("cells"))
    matrix = matrix.agg(F.transform(F.sort_array(F.collect_list(F.struct("actual", F.transform("cells", lambda c: c["n"]).alias("row")))), lambda r: r["row"]).alias("confusion_matrix"))
    return overall(rows).crossJoin(matrix).crossJoin(stats).withColumn("positive", F.element_at("per_class", F.lit(POSITIVE_CLASS)))


def row_shares(rows: DataFrame, k: int = len(CLASSES)) -> DataFrame:
    """Each cell's share of its row of the matrix, and its tone from 0 to 3."""
    share = safe_divide(F.col("n"), F.sum("n").over(W.partitionBy("actual")))
    return confusion(rows, k).withColumn("share", share).withColumn("tone", F.rint(F.col("share") * 3).cast("int"))


def _in_run(*more: str):
    return W.partitionBy("run_id").orderBy("epoch", *more)


def with_best_so_far(history: DataFrame) -> DataFrame:
    """history (run_id, epoch, val_loss) with the best loss before each epoch and whether it improves on it strictly."""
    before = F.min("val_loss").over(_in_run().rowsBetween(W.unboundedPreceding, -1))
    out = history.withColumn("best_before", before)
    return out.withColumn("improved", F.col("best_before").isNull() | (F.col("val_loss") < F.col("best_before")))


def early_stop(history: DataFrame, patience: int) -> DataFrame:
    """(run_id, stop_epoch, epochs_run): the first epoch that ends ``patience`` epochs in a row without improvement."""
    island = F.count_if("improved").over(_in_run().rowsBetween(W.unboundedPreceding, 0))
    streak = F.row_number().over(W.partitionBy("run_id", "island").orderBy("epoch")) - 1
    out = with_best_so_far(history).withColumn("island", island).withColumn("streak", streak)
    stop = out.groupBy("run_id").agg(F.min(F.when(F.col("streak") >= patience, F.col("epoch"))).alias("stop_epoch"), F.max("epoch").alias("last"))
    return stop.select("run_id", "stop_epoch", F.coalesce("stop_epoch", "last").alias("epochs_run"))


def best_epoch(history: DataFrame) -> DataFrame:
    """The epoch with the smallest loss of each run, the earliest on ties."""
    return history.groupBy("run_id").agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"), F.min("val_loss").alias("best_loss"))


def segments(history: DataFrame) -> DataFrame:
    """Line segments between neighbouring epochs."""
    prior = lambda c: F.lag(c).over(_in_run())
    out = history.select("run_id", prior("epoch").alias("x0"), prior("val_loss").alias("y0"), F.col("epoch").alias("x1"), F.col("val_loss").alias("y1"))
    return out.where(F.col("x0").isNotNull())


def rescaled(history: DataFrame) -> DataFrame:
    """Places on axes from 0 to 1 within each run; a flat run lies at 0."""
    w = W.partitionBy("run_id")
    x = (F.col("epoch") - 1) / F.greatest(F.max("epoch").over(w) - 1, F.lit(1))
    low, high = F.min("val_loss").over(w), F.max("val_loss").over(w)
    return history.select("run_id", "epoch", x.cast("double").alias("x"), safe_divide(F.col("val_loss") - low, high - low).alias("y"))


def weighted_means(batches: DataFrame) -> DataFrame:
    """Mean loss weighted by batch size and accuracy, by run."""
    n = F.greatest(F.sum("batch_n"), F.lit(1)).cast("double")
    return batches.groupBy("run_id").agg((F.sum(F.col("loss") * F.col("batch_n")) / n).alias("mean_loss"), (F.sum("correct") / n).alias("accuracy"))


def history_against_summary(history: DataFrame, summary: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """Per run, whether the recorded number of epochs, best epoch and best loss agree with the history."""
    seen = best_epoch(history).join(history.groupBy("run_id").agg(F.count("*").alias("epochs")), "run_id")
    both = seen.join(summary, "run_id", "full_outer")
    return both.select(
        "run_id",
        F.coalesce(F.col("epochs") == F.col("said_epochs"), F.lit(False)).alias("same_count"),
        F.coalesce(F.col("best_epoch") == F.col("said_best"), F.lit(False)).alias("same_best"),
        F.coalesce(F.abs(F.col("best_loss") - F.col("said_loss")) <= tolerance, F.lit(False)).alias("close_loss"),
    )


def report_row(rows: DataFrame) -> DataFrame:
    """The evaluation report in one flat row; the matrix by rows, actual by actual."""
    cells = confusion(rows).agg(F.sort_array(F.collect_list(F.struct("actual", "predicted", "n"))).alias("c"))
    cells = cells.select(F.array_join(F.transform("c", lambda x: x["n"].cast("string")), ",").alias("confusion_matrix"))
    of = lambda name, i: F.max(F.when(F.col("index") == i, F.col(name))).alias(f"{name}_{CLASSES[i]}")
    each = per_class(rows).agg(*(of(name, i) for i in range(len(CLASSES)) for name in ("precision", "recall", "f1", "support")))
    return overall(rows).crossJoin(cells).crossJoin(each)


def report_lines(report: DataFrame) -> DataFrame:
    """The lines of the printed report of ``report_row``, numbered from 1; rates with four decimals."""
    rate = lambda c: F.format_string("%.4f", F.bround(F.col(c), 4))
    line = lambda name, value: F.concat(F.rpad(F.lit(name), 17, " "), F.lit(": "), value)
    p = POSITIVE_CLASS
    parts = [
        line("Test images", F.col("num_samples").cast("string")), line("Accuracy", rate("accuracy")),
        *(line(f"{name} ({p})", rate(f"{name.lower()}_{p}")) for name in ("Precision", "Recall", "F1")),
        *(line(f"Macro {name}", rate(f"macro_{name}")) for name in ("precision", "recall", "f1")),
        *(F.concat(F.lpad(F.lit(c), 5, " "), F.lit(": precision="), rate(f"precision_{c}"), F.lit("  recall="), rate(f"recall_{c}"), F.lit("  f1="), rate(f"f1_{c}"), F.lit("  support="), F.col(f"support_{c}").cast("string")) for c in CLASSES),
        *(F.concat(F.lpad(F.lit(c), 4, " "), *(F.lpad(F.get(F.split("confusion_matrix", ","), F.lit(i * len(CLASSES) + j)), 10, " ") for j in range(len(CLASSES)))) for i, c in enumerate(CLASSES)),
    ]
    return report.select(F.posexplode(F.array(*parts)).alias("pos", "text")).select((F.col("pos") + 1).alias("line"), "text")


def throughput(rows: DataFrame, n: str, started: str, ended: str) -> DataFrame:
    """rows with ``per_second``: n over the seconds between two timestamps, of which a millionth counts at least."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros(ended) - micros(started)) / F.lit(1e6)
    return rows.withColumn("per_second", F.col(n).cast("double") / F.greatest(seconds, F.lit(1e-6)))
