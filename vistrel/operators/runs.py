"""Summaries of evaluation rows. Means of means, kinds of standard deviation and missing values follow a rule for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vistrel.operators.ranks import value_ranks
from vistrel.session import written

DIGITS = 6


def r(c: Column, digits: int = DIGITS) -> Column:
    return F.round(c, digits)


def two_level(runs: DataFrame, metric: str = "mAP", sample: bool = False) -> DataFrame:
    """Mean over splits per seed, then mean and standard deviation over seeds; population, or sample (null for one seed)."""
    per_seed = runs.groupBy("domain", "k", "seed").agg(F.avg(metric).alias("m"))
    spread = F.stddev_samp("m") if sample else F.stddev_pop("m")
    return per_seed.groupBy("domain", "k").agg(F.count("*").alias("n_seeds"), r(F.avg("m")).alias("mean"), r(spread).alias("std"))


def complete_summary(runs: DataFrame, splits: int, metric: str = "mAP") -> DataFrame:
    """two_level with a check that each seed covers splits 0..n-1; std is null for a single seed, and what is incomplete is marked."""
    per_split = runs.groupBy("domain", "k", "seed", "split").agg(F.avg(metric).alias("m"))
    per_seed = per_split.groupBy("domain", "k", "seed").agg(F.avg("m").alias("m"), ((F.count("*") == splits) & (F.min("split") == 0) & (F.max("split") == splits - 1)).alias("full"))
    return per_seed.groupBy("domain", "k").agg(
        F.count("*").alias("n_seeds"), r(F.avg("m")).alias("mean"), r(F.when(F.count("*") > 1, F.stddev_pop("m"))).alias("std"), F.bool_and("full").alias("complete")
    )


def require_complete(summary: DataFrame) -> DataFrame:
    """The summary; reading a row that is not complete fails."""
    return summary.where(F.when(F.col("complete"), True).otherwise(F.raise_error(F.concat(F.lit("splits are missing in "), F.col("domain"))).cast("boolean")))


def validation_means(runs: DataFrame) -> DataFrame:
    """Mean per domain, then over domains."""
    per = runs.groupBy("domain").agg(F.avg("mAP").alias("mAP"), F.avg("rank1").alias("rank1"))
    return per.agg(F.count("*").alias("n_domains"), r(F.avg("mAP")).alias("val_mean_mAP"), r(F.avg("rank1")).alias("val_mean_rank1"))


def selector_summary(runs: DataFrame, baseline: str = "random") -> DataFrame:
    """Per split statistics of each condition, averaged over splits, against the baseline's mean and best draw."""
    per_split = runs.groupBy("domain", "k", "condition", "split").agg(F.avg("mAP").alias("mean"), F.stddev_pop("mAP").alias("std"), F.min("mAP").alias("worst"), F.max("mAP").alias("best"))
    per = per_split.groupBy("domain", "k", "condition").agg(*(F.avg(c).alias(c) for c in ("mean", "std", "worst", "best")))
    pairs = runs.groupBy("domain", "k", "condition").agg(F.avg("n_pairs").alias("n_pairs"))
    base = per.where(F.col("condition") == baseline).select("domain", "k", F.col("mean").alias("rnd"), F.col("best").alias("oracle"))
    return (
        per.join(pairs, ["domain", "k", "condition"])
        .join(base, ["domain", "k"], "left")
        .select(
            "domain", "k", "condition", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), r(F.col("worst")).alias("worst"),
            r(F.col("mean") - F.col("rnd")).alias("vs_random"), r(F.col("oracle")).alias("random_oracle"), r(F.col("oracle") - F.col("mean")).alias("gap_to_oracle"), r(F.col("n_pairs")).alias("n_pairs"),
        )
    )


def sensitivity_summary(runs: DataFrame) -> DataFrame:
    """Random draws, first, noise and zero conditions side by side. A split with fewer than two noise values has no spread, and
    makes the mean of spreads NaN, as a mean over numbers that are not there."""
    of = lambda c, v="mAP": F.when(F.col("condition") == c, F.col(v))
    per_split = runs.groupBy("domain", "k", "split").agg(
        F.avg(of("random")).alias("rand_mean"), F.stddev_pop(of("random")).alias("rand_std"), F.min(of("random")).alias("rand_min"), F.max(of("random")).alias("oracle"),
        F.avg(of("random", "rank1")).alias("rand_r1_mean"), F.max(of("random", "rank1")).alias("oracle_r1"), F.avg(of("first")).alias("first"),
        F.when(F.count(of("noise")) > 1, F.stddev_pop(of("noise"))).otherwise(float("nan")).alias("noise_std"), F.avg(of("zero")).alias("zero_mAP"),
    )
    names = ("rand_mean", "rand_std", "rand_min", "oracle", "rand_r1_mean", "oracle_r1", "first", "noise_std", "zero_mAP")
    per = per_split.groupBy("domain", "k").agg(F.count("*").alias("splits"), *(F.avg(c).alias(c) for c in names))
    return per.select("domain", "k", "splits", *(r(F.col(c)).alias(c) for c in names), r(F.col("oracle") - F.col("rand_mean")).alias("gap_mean"), r(F.col("oracle") - F.col("rand_min")).alias("gap_min"))


def diagnostics_summary(runs: DataFrame, reference: str = "true") -> DataFrame:
    """Flat mean of each condition, its difference to the reference condition, and the mean of the domain's zero runs. NaN counts as missing."""
    clean = F.nanvl(F.col("mAP"), F.lit(None).cast("double"))
    per = runs.where(F.col("condition") != "zero").groupBy("domain", "k", "condition").agg(F.avg(clean).alias("m"), F.avg("rank1").alias("rank1"), F.count("*").alias("n"))
    ref = per.where(F.col("condition") == reference).select("domain", "k", F.col("m").alias("ref"))
    zero = runs.where(F.col("condition") == "zero").groupBy("domain").agg(F.avg(clean).alias("zero_mAP"))
    return per.join(ref, ["domain", "k"], "left").join(zero, "domain", "left").select(
        "domain", "k", "condition", r(F.col("m")).alias("mAP"), r(F.col("m") - F.col("ref")).alias("d_mAP"), r(F.col("rank1")).alias("rank1"), r(F.col("zero_mAP")).alias("zero_mAP"), "n"
    )


def context_gain(runs: DataFrame, own: str, base: str, reference: str, cross: str) -> DataFrame:
    """Mean of per-split means of each role, spread of the own condition, and what own gains over the others."""
    per_split = runs.groupBy("domain", "condition", "split").agg(F.avg("mAP").alias("m"), F.stddev_pop("mAP").alias("s"))
    per = per_split.groupBy("domain", "condition").agg(F.avg("m").alias("m"), F.avg("s").alias("s"))
    of = lambda c, v="m": F.max(F.when(F.col("condition") == c, F.col(v)))
    wide = per.groupBy("domain").agg(of(own).alias("own"), of(own, "s").alias("own_std"), of(base).alias("base"), of(reference).alias("reference"), of(cross).alias("cross_"))
    d = lambda x, y: r(F.col(x) - F.col(y))
    return wide.select("domain", r(F.col("own")).alias("own"), r(F.col("own_std")).alias("own_std"), d("own", "base").alias("gain_vs_base"), d("own", "reference").alias("gain_vs_ref"), d("own", "cross_").alias("specificity"))


def label_value(runs: DataFrame, sample: bool) -> DataFrame:
    """Per-split mean, spread, least and greatest over draws, averaged over splits."""
    per_split = runs.groupBy("domain", "k", "condition", "split").agg(
        F.avg("mAP").alias("mean"), (F.stddev_samp("mAP") if sample else F.stddev_pop("mAP")).alias("std"), F.min("mAP").alias("worst"), F.max("mAP").alias("best")
    )
    per = per_split.groupBy("domain", "k", "condition").agg(*(F.avg(c).alias(c) for c in ("mean", "std", "worst", "best")))
    return per.select("domain", "k", "condition", *(r(F.col(c)).alias(c) for c in ("mean", "std", "worst", "best")), r(F.col("best") - F.col("mean")).alias("oracle_gap"), r(F.col("mean") - F.col("worst")).alias("worst_gap"))


def draw_spread(runs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Sample standard deviation over the draws of a split for each metric, averaged over splits; a row per metric."""
    long = runs.select("domain", "split", *metrics).unpivot(["domain", "split"], list(metrics), "metric", "v")
    per_split = long.groupBy("domain", "metric", "split").agg(F.stddev_samp("v").alias("s"))
    return per_split.groupBy("domain", "metric").agg(r(F.avg("s")).alias("draw_std"), F.count("*").alias("n_splits"))


def group_means(runs: DataFrame, *by: str) -> DataFrame:
    return runs.groupBy(*by).agg(r(F.avg("rank1")).alias("rank1"), r(F.avg("mAP")).alias("mAP"), F.count("*").alias("n"))


def condition_pivot(runs: DataFrame, conditions: tuple[str, ...], order: DataFrame) -> DataFrame:
    """Conditions as columns, domains in the order of a table (domain, pos); rows without any value are dropped."""
    wide = runs.groupBy("domain").pivot("condition", list(conditions)).agg(F.avg("mAP"))
    wide = order.join(wide, "domain", "left").select("domain", "pos", *(r(F.col(c)).alias(c) for c in conditions))
    return wide.dropna("all", subset=list(conditions))


def distinct_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("domain").agg(*(F.countDistinct(c).alias(f"n_{c}") for c in ("split", "seed", "draw", "condition")))


def pearson(runs: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Correlation in each group; null where a column is constant."""
    varied = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    sums = runs.groupBy(*by).agg(F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), varied.alias("varied"), F.count("*").alias("n"))
    return sums.select(*by, r(F.when(F.col("varied"), F.col("c") / F.when(F.col("varied"), F.col("sx") * F.col("sy")))).alias("r"), "n")


def spearman(runs: DataFrame, x: str, y: str, within: tuple[str, ...], *by: str, least: int = 5) -> DataFrame:
    """Rank correlation of the rows that are finite in both columns, after each column is centred within groups over its own finite
    values; null for three such rows or fewer. Groups of under ``least`` rows are left out; n counts all rows of a group."""
    known = runs.select(*by, *within, *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(n) for c, n in ((x, "x"), (y, "y"))))
    means = known.groupBy(*by, *within).agg(*(F.avg(c).alias(f"_{c}") for c in ("x", "y")))
    centred = known.join(means, [*by, *within]).select(*by, *(r(F.col(c) - F.col(f"_{c}"), 9).alias(c) for c in ("x", "y")))
    both = written(centred.where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.count("*").alias("n")), "centred")

    def ranks(c: str) -> DataFrame:
        return value_ranks(both.groupBy(*by, c).agg(F.sum("n").alias("_n")), list(by), c, "_n").select(*by, c, F.col("rank").alias(f"r{c}"))

    ranked = both.join(ranks("x"), [*by, "x"]).join(ranks("y"), [*by, "y"])
    rho = weighted_pearson(ranked, "rx", "ry", "n", *by).select(*by, F.when(F.col("n") > 3, F.col("r")).alias("rho"))
    counts = runs.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(rho, list(by), "left").select(*by, "rho", "n")


def weighted_pearson(rows: DataFrame, x: str, y: str, n: str, *by: str) -> DataFrame:
    """Correlation in each group of rows that stand for ``n`` each; null where a column is constant. Sums are taken around the means."""
    means = rows.groupBy(*by).agg(*((F.sum(F.col(c) * F.col(n)) / F.sum(n)).alias(f"_{c}") for c in (x, y)))
    a, b = F.col(x) - F.col(f"_{x}"), F.col(y) - F.col(f"_{y}")
    sums = rows.join(means, list(by)).groupBy(*by).agg(F.sum(a * b * F.col(n)).alias("c"), F.sum(a * a * F.col(n)).alias("sx"), F.sum(b * b * F.col(n)).alias("sy"), F.sum(n).alias("n"))
    varied = (F.col("sx") > 0) & (F.col("sy") > 0)
    return sums.select(*by, r(F.when(varied, F.col("c") / F.when(varied, F.sqrt("sx") * F.sqrt("sy")))).alias("r"), "n")


def rate_selection(runs: DataFrame, base: str = "zero") -> DataFrame:
    """Per rate (seed column) and k: mean, mean gain over the domain's base condition, sample standard deviation."""
    ref = runs.where(F.col("condition") == base).groupBy("domain").agg(F.avg("mAP").alias("ref"))
    joined = runs.where(F.col("condition") != base).join(ref, "domain", "left")
    return joined.groupBy(F.col("seed").alias("rate"), "k").agg(r(F.avg("mAP")).alias("mean"), r(F.avg(F.col("mAP") - F.col("ref"))).alias("gain"), r(F.stddev_samp("mAP")).alias("std"), F.count("*").alias("n"))


def grid(*options: DataFrame) -> DataFrame:
    """All combinations of option tables, which are lists that someone wrote."""
    out = options[0]
    for other in options[1:]:
        out = out.crossJoin(other)
    return out


def option_grids(options: DataFrame) -> DataFrame:
    """(plan, task): every plan's combinations of its options (plan, name, value), as name=value in the order of names. Plans may have
    different options; each is a list that someone wrote."""
    placed = options.distinct().select("plan", "name", F.dense_rank().over(W.Window.partitionBy("plan").orderBy("name")).alias("at"), F.concat_ws("=", "name", "value").alias("set"))
    depth = placed.groupBy("plan").agg(F.max("at").alias("depth"))
    out = placed.where("at = 1").select("plan", F.array("set").alias("task"))
    for at in range(2, (depth.agg(F.max("depth")).first()[0] or 1) + 1):
        further = placed.where(F.col("at") == at).select("plan", "set")
        out = out.join(further, "plan", "left").select("plan", F.when(F.col("set").isNull(), F.col("task")).otherwise(F.concat("task", F.array("set"))).alias("task"))
    return out


def merge_options(saved: DataFrame, given: DataFrame) -> DataFrame:
    """(name, value, origin): a saved option overrides a given one."""
    joined = saved.withColumnRenamed("value", "saved").join(given.withColumnRenamed("value", "given"), "name", "full_outer")
    return joined.select("name", F.coalesce("saved", "given").alias("value"), F.when(F.col("saved").isNotNull(), "saved").otherwise("given").alias("origin"))


def transfer_pairs(units: DataFrame) -> DataFrame:
    """(split, src, dst): every ordered pair of different domains of a split."""
    a, b = units.select("split", F.col("domain").alias("src")), units.select("split", F.col("domain").alias("dst"))
    return a.distinct().join(b.distinct(), "split").where("src <> dst")


def keep_rule(summary: DataFrame, least: float = 1.0) -> DataFrame:
    """The options whose delta is large enough."""
    return summary.where(F.col("delta") >= least)


def noise_corrected(total: Column, noise: Column) -> Column:
    return F.sqrt(F.greatest(total * total - noise * noise, F.lit(0.0)))


def fold_options(options: DataFrame, *by: str) -> DataFrame:
    """(by.., pos, option) of options (by.., pos, option), a list that someone wrote for each ``by``: an option with any flag of an earlier kept one of
    its list is dropped, whole.

    Options without flags stay. Of those with the same flags only the first can stay, so the fold runs over distinct sets of flags.
    """
    flags = F.array_sort(F.array_distinct(F.regexp_extract_all("option", F.lit(r"(--\w+)"), F.lit(1))))
    rows = options.select(*by, "pos", "option", flags.alias("flags"))
    firsts = rows.where(F.size("flags") > 0).groupBy(*by, "flags").agg(F.min(F.struct("pos", "option")).alias("first"))
    lists = firsts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("first", "flags"))).alias("sets"))
    none = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(lists.select(F.transform("sets", lambda s: s["first"]).alias("v")).schema["v"].dataType).alias("kept"))

    def step(s: Column, o: Column) -> Column:
        free = ~F.arrays_overlap(s["seen"], o["flags"])
        return F.when(free, F.struct(F.concat(s["seen"], o["flags"]).alias("seen"), F.concat(s["kept"], F.array(o["first"])).alias("kept"))).otherwise(s)

    kept = lists.select(*by, F.explode(F.aggregate("sets", none, step, lambda s: s["kept"])).alias("o")).select(*by, "o.pos", "o.option")
    return rows.where(F.size("flags") == 0).select(*by, "pos", "option").unionByName(kept)


def grid_rows(runs: DataFrame, questions: DataFrame, by: list[str]) -> DataFrame:
    """Evaluation rows with the accuracy and AUC of their questions (by.., accuracy, auc); NaN where no questions were asked."""
    nan = F.lit(float("nan"))
    joined = runs.join(questions.select(*by, "accuracy", "auc"), by, "left")
    return joined.select(*runs.columns, F.coalesce("accuracy", nan).alias("llm_acc"), F.coalesce("auc", nan).alias("llm_auc"))


def banked(rows: DataFrame, conditions: tuple[str, ...]) -> DataFrame:
    """The rows whose prompts are kept: the first split and the largest k under the named conditions."""
    most = rows.agg(F.max("k").alias("_most"))  # one row
    return rows.join(F.broadcast(most), F.col("k") == F.col("_most")).where((F.col("split") == 0) & F.col("condition").isin(*conditions)).drop("_most")


def first_available(*named: tuple[str, Column]) -> Column:
    """struct<origin, value> of the first value that is there; origin `none` without any."""
    none = F.struct(F.lit("none").alias("origin"), F.lit(None).cast("double").alias("value"))
    return F.coalesce(*(F.when(c.isNotNull(), F.struct(F.lit(n).alias("origin"), c.cast("double").alias("value"))) for n, c in named), none)


def stage_decision(scores: DataFrame, old: str, new: str, full: str, small: str) -> DataFrame:
    """One row of scores (run, score): whether the new loss is at least as good as the old one, by how much, and what full training gains
    over the small one (null where either is missing). A missing old or new score is an error."""
    of = lambda n: F.max(F.when(F.col("run") == n, F.col("score")))
    one = scores.agg(of(old).alias("a"), of(new).alias("b"), of(full).alias("f"), of(small).alias("s"))
    chosen = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit(f"both {old} and {new} are needed")).cast("string")).when(F.col("b") >= F.col("a"), new).otherwise(old)
    return one.select(chosen.alias("chosen"), r(F.col("b") - F.col("a")).alias("gain"), r(F.col("f") - F.col("s")).alias("full_gain"))


def source_folds(domains: DataFrame) -> DataFrame:
    """(val, sources): each source domain is the validation of a fold that trains on the others, named in their order and joined by commas."""
    return leave_one_out(domains).select(F.col("target").alias("val"), F.array_join("sources", ",").alias("sources"))


def leave_one_out(domains: DataFrame) -> DataFrame:
    """(target, sources): for each domain all the others in their order, a short list of names."""
    other = domains.select(F.col("domain").alias("source"))
    joined = domains.select(F.col("domain").alias("target")).crossJoin(other).where("target <> source")
    return joined.groupBy("target").agg(F.array_sort(F.collect_list("source")).alias("sources"))


def pick_columns(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    """Names of the columns with a prefix and a suffix."""
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]
