"""Training logs: windows over the steps of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vistrel.operators.identity import by_thousands
from vistrel.operators.runs import r


def moving_average(log: DataFrame, width: int) -> DataFrame:
    """Mean of the last ``width`` points; only full windows."""
    by = W.Window.partitionBy("run").orderBy("step")
    out = log.select("run", "step", r(F.avg("loss").over(by.rowsBetween(1 - width, 0))).alias("avg_loss"), F.row_number().over(by).alias("_rn"))
    return out.where(F.col("_rn") >= width).drop("_rn")


def step_windows(log: DataFrame, width: int) -> DataFrame:
    """Mean per window of steps (lo, lo + width]."""
    return log.groupBy("run", (F.floor((F.col("step") - 1) / width) * width).cast("long").alias("lo")).agg(r(F.avg("loss")).alias("avg_loss"), F.count("*").alias("n"))


def _from_end(log: DataFrame) -> DataFrame:
    return log.select("run", "step", "loss", F.row_number().over(W.Window.partitionBy("run").orderBy(F.desc("step"))).alias("_back"), F.count("*").over(W.Window.partitionBy("run")).alias("_n"))


def last_means(log: DataFrame, counts: tuple[int, ...] = (3, 5, 20)) -> DataFrame:
    """Mean of the last points of each run for several counts."""
    return _from_end(log).groupBy("run").agg(*(r(F.avg(F.when(F.col("_back") <= n, F.col("loss")))).alias(f"last{n}") for n in counts))


def quarter_trend(log: DataFrame) -> DataFrame:
    """Mean of the last quarter of a run's points against the quarter before; both sums are divided by the quarter's size."""
    q = F.greatest(F.floor(F.col("_n") / 4), F.lit(1))
    placed = _from_end(log).withColumn("_q", q)
    last = F.sum(F.when(F.col("_back") <= F.col("_q"), F.col("loss") / F.col("_q")))
    before = F.sum(F.when((F.col("_back") > F.col("_q")) & (F.col("_back") <= 2 * F.col("_q")), F.col("loss") / F.col("_q")))
    folded = placed.groupBy("run").agg(last.alias("last"), F.coalesce(before, F.lit(0.0)).alias("before"))
    return folded.select("run", r(F.col("last")).alias("last_quarter"), r(F.col("before")).alias("previous_quarter"), r(F.col("last") - F.col("before")).alias("trend"))


def best_step(log: DataFrame) -> DataFrame:
    """First step with the greatest value of each run."""
    best = log.select("*", F.row_number().over(W.Window.partitionBy("run").orderBy(F.desc("loss"), "step")).alias("_rn")).where("_rn = 1")
    return best.select("run", F.col("step").alias("best_step"), F.col("loss").alias("best"))


def run_table(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Last-three mean, best value and number of points of each wanted run; nulls where a run is missing."""
    summary = last_means(log, (3,)).join(best_step(log), "run").join(log.groupBy("run").agg(F.count("*").alias("evals")), "run")
    return wanted.join(summary, "run", "left").select("run", "last3", "best", F.coalesce("evals", F.lit(0)).alias("evals"), F.col("evals").isNull().alias("missing"))


def end_means(log: DataFrame, n: int = 20) -> DataFrame:
    """Mean of the first and of the last n points."""
    first = F.row_number().over(W.Window.partitionBy("run").orderBy("step"))
    placed = _from_end(log).withColumn("_at", first)
    return placed.groupBy("run").agg(r(F.avg(F.when(F.col("_at") <= n, F.col("loss")))).alias("loss_start"), r(F.avg(F.when(F.col("_back") <= n, F.col("loss")))).alias("loss_end"))


def running_ema(log: DataFrame, keep: float = 0.99) -> DataFrame:
    """Last value of the exponential average; the first point starts it.

    A stretch of points maps the average before it to keep ** points times it, plus a sum of its own. Such maps follow each other by
    products and sums, so a run is summed by parts of its steps, each weighed by the number of points after it.
    """
    placed = log.select("run", "step", "loss", by_thousands("step").alias("_part"))
    own = W.Window.partitionBy("run", "_part")
    back = F.row_number().over(own.orderBy(F.desc("step"), F.desc("loss"))) - 1
    parts = placed.withColumn("_back", back).groupBy("run", "_part").agg(
        F.count("*").alias("_n"), F.sum(F.col("loss") * (1 - keep) * F.pow(F.lit(keep), F.col("_back"))).alias("_sum"), F.min(F.struct("step", "loss")).alias("_first")
    )
    later = W.Window.partitionBy("run").orderBy(F.desc("_part")).rowsBetween(W.Window.unboundedPreceding, -1)  # a row for each part
    weighed = parts.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    folded = weighed.groupBy("run").agg(F.sum(F.col("_sum") * F.pow(F.lit(keep), F.col("_after"))).alias("s"), F.sum("_n").alias("n"), F.min("_first").alias("first"))
    return folded.select("run", r(F.col("s") + F.pow(F.lit(keep), F.col("n")) * F.col("first.loss")).alias("ema"))
