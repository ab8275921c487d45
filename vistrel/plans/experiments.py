"""Run-log queries: summaries, comparisons, training curves, question metrics, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistrel.operators import logs, metric, runs
from vistrel.plans.registry import query
from vistrel.sources.views import CONDITIONS, IMAGES, LOG, QUESTIONS, RUNS, images, log_points, question_scores, table
from vistrel.sources.views import runs as run_rows
from vistrel.streaming import events

_SEEDS = f"WITH {RUNS}, s AS (SELECT domain, k, seed, avg(mAP) AS m FROM runs GROUP BY ALL)"


@query(f"{_SEEDS} SELECT domain, k, count(*) AS n_seeds, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM s GROUP BY domain, k")
def runs_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.two_level(run_rows(spark, sf_dir))


@query(f"{_SEEDS} SELECT domain, k, count(*) AS n_seeds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std FROM s GROUP BY domain, k")
def runs_two_level_sample_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.two_level(run_rows(spark, sf_dir), sample=True)


@query(
    f"""WITH {RUNS}, p AS (SELECT domain, k, seed, split, avg(mAP) AS m FROM runs GROUP BY ALL),
    s AS (SELECT domain, k, seed, avg(m) AS m, count(*) = 10 AND min(split) = 0 AND max(split) = 9 AS full_ FROM p GROUP BY ALL)
    SELECT domain, k, count(*) AS n_seeds, round(avg(m), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_pop(m) END, 6) AS std, bool_and(full_) AS complete FROM s GROUP BY domain, k"""
)
def runs_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.complete_summary(run_rows(spark, sf_dir), 10)


@query(f"WITH {RUNS}, p AS (SELECT domain, avg(mAP) AS m, avg(rank1) AS r FROM runs GROUP BY domain) SELECT count(*) AS n_domains, round(avg(m), 6) AS \"val_mean_mAP\", round(avg(r), 6) AS val_mean_rank1 FROM p")
def validation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.validation_means(run_rows(spark, sf_dir))


@query(
    f"""WITH {RUNS}, s AS (SELECT domain, k, condition, split, avg(mAP) AS mean, stddev_pop(mAP) AS std, min(mAP) AS worst, max(mAP) AS best FROM runs GROUP BY domain, k, condition, split),
    p AS (SELECT domain, k, condition, avg(mean) AS mean, avg(std) AS std, avg(worst) AS worst, avg(best) AS best FROM s GROUP BY domain, k, condition),
    n AS (SELECT domain, k, condition, avg(n_pairs) AS n_pairs FROM runs GROUP BY domain, k, condition)
    SELECT p.domain, p.k, p.condition, round(p.mean, 6) AS mean, round(p.std, 6) AS std, round(p.worst, 6) AS worst, round(p.mean - b.mean, 6) AS vs_random,
           round(b.best, 6) AS random_oracle, round(b.best - p.mean, 6) AS gap_to_oracle, round(n.n_pairs, 6) AS n_pairs
    FROM p JOIN n ON p.domain = n.domain AND p.k = n.k AND p.condition = n.condition LEFT JOIN p b ON p.domain = b.domain AND p.k = b.k AND b.condition = 'random'"""
)
def selector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.selector_summary(run_rows(spark, sf_dir))


@query(
    f"""WITH {RUNS}, s AS (
        SELECT domain, k, split, avg(mAP) FILTER (condition = 'random') AS rand_mean, stddev_pop(mAP) FILTER (condition = 'random') AS rand_std, min(mAP) FILTER (condition = 'random') AS rand_min,
               max(mAP) FILTER (condition = 'random') AS oracle, avg(rank1) FILTER (condition = 'random') AS rand_r1_mean, max(rank1) FILTER (condition = 'random') AS oracle_r1,
               avg(mAP) FILTER (condition = 'first') AS first,
               CASE WHEN count(mAP) FILTER (condition = 'noise') > 1 THEN stddev_pop(mAP) FILTER (condition = 'noise') ELSE CAST('nan' AS DOUBLE) END AS noise_std, avg(mAP) FILTER (condition = 'zero') AS zero_map
        FROM runs GROUP BY domain, k, split)
    SELECT domain, k, count(*) AS splits, round(avg(rand_mean), 6) AS rand_mean, round(avg(rand_std), 6) AS rand_std, round(avg(rand_min), 6) AS rand_min, round(avg(oracle), 6) AS oracle,
           round(avg(rand_r1_mean), 6) AS rand_r1_mean, round(avg(oracle_r1), 6) AS oracle_r1, round(avg(first), 6) AS first, round(avg(noise_std), 6) AS noise_std, round(avg(zero_map), 6) AS "zero_mAP", round(avg(oracle) - avg(rand_mean), 6) AS gap_mean, round(avg(oracle) - avg(rand_min), 6) AS gap_min
    FROM s GROUP BY domain, k"""
)
def sensitivity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sensitivity_summary(run_rows(spark, sf_dir))


@query(
    f"""WITH {RUNS}, p AS (SELECT domain, k, condition, avg(mAP) AS m, avg(rank1) AS r1, count(*) AS n FROM runs WHERE condition <> 'zero' GROUP BY domain, k, condition),
    z AS (SELECT domain, avg(mAP) AS zero_map FROM runs WHERE condition = 'zero' GROUP BY domain)
    SELECT p.domain, p.k, p.condition, round(p.m, 6) AS "mAP", round(p.m - t.m, 6) AS "d_mAP", round(p.r1, 6) AS rank1, round(z.zero_map, 6) AS "zero_mAP", p.n
    FROM p LEFT JOIN p t ON p.domain = t.domain AND p.k = t.k AND t.condition = 'true' LEFT JOIN z ON p.domain = z.domain"""
)
def diagnostics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.diagnostics_summary(run_rows(spark, sf_dir))


@query(
    f"""WITH {RUNS}, s AS (SELECT domain, condition, split, avg(mAP) AS m, stddev_pop(mAP) AS s FROM runs GROUP BY domain, condition, split),
    p AS (SELECT domain, condition, avg(m) AS m, avg(s) AS s FROM s GROUP BY domain, condition),
    w AS (SELECT domain, max(m) FILTER (condition = 'own') AS own, max(s) FILTER (condition = 'own') AS own_std, max(m) FILTER (condition = 'first') AS base,
                 max(m) FILTER (condition = 'true') AS reference, max(m) FILTER (condition = 'shuffle') AS cross_ FROM p GROUP BY domain)
    SELECT domain, round(own, 6) AS own, round(own_std, 6) AS own_std, round(own - base, 6) AS gain_vs_base, round(own - reference, 6) AS gain_vs_ref, round(own - cross_, 6) AS specificity FROM w"""
)
def context_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.context_gain(run_rows(spark, sf_dir), own="own", base="first", reference="true", cross="shuffle")


def _label_value(std: str) -> str:
    return f"""WITH {RUNS}, s AS (SELECT domain, k, condition, split, avg(mAP) AS mean, {std}(mAP) AS std, min(mAP) AS worst, max(mAP) AS best FROM runs GROUP BY domain, k, condition, split),
    p AS (SELECT domain, k, condition, avg(mean) AS mean, avg(std) AS std, avg(worst) AS worst, avg(best) AS best FROM s GROUP BY domain, k, condition)
    SELECT domain, k, condition, round(mean, 6) AS mean, round(std, 6) AS std, round(worst, 6) AS worst, round(best, 6) AS best, round(best - mean, 6) AS oracle_gap, round(mean - worst, 6) AS worst_gap FROM p"""


@query(_label_value("stddev_pop"))
def label_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.label_value(run_rows(spark, sf_dir), sample=False)


@query(_label_value("stddev_samp"))
def label_value_sample_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.label_value(run_rows(spark, sf_dir), sample=True)


@query(
    f"""WITH {RUNS}, l AS (SELECT domain, split, 'mAP' AS metric, mAP AS v FROM runs UNION ALL SELECT domain, split, 'rank1', rank1 FROM runs),
    s AS (SELECT domain, metric, split, stddev_samp(v) AS s FROM l GROUP BY domain, metric, split)
    SELECT domain, metric, round(avg(s), 6) AS draw_std, count(*) AS n_splits FROM s GROUP BY domain, metric"""
)
def draw_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.draw_spread(run_rows(spark, sf_dir), ("mAP", "rank1"))


@query(f"WITH {RUNS} SELECT domain, seed, condition, round(avg(rank1), 6) AS rank1, round(avg(mAP), 6) AS \"mAP\", count(*) AS n FROM runs GROUP BY domain, seed, condition")
def train_domain_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.group_means(run_rows(spark, sf_dir), "domain", "seed", "condition")


_ORDER = [("view", 0), ("click", 1), ("purchase", 2), ("absent", 3)]


@query(
    f"""WITH {RUNS}, o(domain, pos) AS (VALUES {', '.join(f"('{d}', CAST({p} AS BIGINT))" for d, p in _ORDER)}),
    w AS (SELECT o.domain, o.pos, {', '.join(f"round(avg(mAP) FILTER (condition = '{c}'), 6) AS {c}_" for c in CONDITIONS)} FROM o LEFT JOIN runs r ON o.domain = r.domain GROUP BY o.domain, o.pos)
    SELECT domain, pos, {', '.join(f'{c}_ AS "{c}"' for c in CONDITIONS)} FROM w WHERE coalesce({', '.join(f'{c}_' for c in CONDITIONS)}) IS NOT NULL"""
)
def condition_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.condition_pivot(run_rows(spark, sf_dir), CONDITIONS, spark.createDataFrame(_ORDER, "domain string, pos long"))


@query(f"WITH {RUNS} SELECT domain, count(DISTINCT split) AS n_split, count(DISTINCT seed) AS n_seed, count(DISTINCT draw) AS n_draw, count(DISTINCT condition) AS n_condition FROM runs GROUP BY domain")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.distinct_counts(run_rows(spark, sf_dir))


@query(f"WITH {RUNS} SELECT domain, round(CASE WHEN stddev_pop(mAP) > 0 AND stddev_pop(n_pairs) > 0 THEN corr(mAP, n_pairs) END, 6) AS r, count(*) AS n FROM runs GROUP BY domain")
def metric_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.pearson(run_rows(spark, sf_dir), "mAP", "n_pairs", "domain")


@query(
    f"""WITH {RUNS}, c AS (SELECT domain, round(n_pairs - avg(n_pairs) OVER w, 9) AS x, round(mAP - avg(mAP) OVER w, 9) AS y FROM runs WINDOW w AS (PARTITION BY domain, split, k)),
    q AS (SELECT domain, rank() OVER (PARTITION BY domain ORDER BY x) + (count(*) OVER (PARTITION BY domain, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY domain ORDER BY y) + (count(*) OVER (PARTITION BY domain, y) - 1) / 2 AS ry FROM c)
    SELECT domain, CASE WHEN count(*) > 3 THEN round(corr(rx, ry), 6) END AS rho, count(*) AS n FROM q GROUP BY domain HAVING count(*) >= 5"""
)
def metric_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.spearman(run_rows(spark, sf_dir), "n_pairs", "mAP", ("split", "k"), "domain")


@query(
    f"""WITH {RUNS}, b AS (SELECT domain, avg(mAP) AS ref FROM runs WHERE condition = 'zero' GROUP BY domain)
    SELECT seed AS rate, k, round(avg(mAP), 6) AS mean, round(avg(mAP - ref), 6) AS gain, round(stddev_samp(mAP), 6) AS std, count(*) AS n FROM runs LEFT JOIN b ON runs.domain = b.domain WHERE condition <> 'zero' GROUP BY seed, k"""
)
def rate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rate_selection(run_rows(spark, sf_dir))


@query(
    f"""WITH {LOG}, a AS (SELECT run, step, avg(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v, row_number() OVER (PARTITION BY run ORDER BY step) AS rn FROM log)
    SELECT run, step, round(v, 6) AS avg_loss FROM a WHERE rn >= 10"""
)
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.moving_average(log_points(spark, sf_dir), 10)


@query(f"WITH {LOG} SELECT run, (step - 1) // 5 * 5 AS lo, round(avg(loss), 6) AS avg_loss, count(*) AS n FROM log GROUP BY run, (step - 1) // 5 * 5")
def log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.step_windows(log_points(spark, sf_dir), 5)


_BACK = f"WITH {LOG}, b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS back, row_number() OVER (PARTITION BY run ORDER BY step) AS at_, count(*) OVER (PARTITION BY run) AS n FROM log)"


@query(f"{_BACK} SELECT run, round(avg(loss) FILTER (back <= 3), 6) AS last3, round(avg(loss) FILTER (back <= 5), 6) AS last5, round(avg(loss) FILTER (back <= 20), 6) AS last20 FROM b GROUP BY run")
def last_n_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.last_means(log_points(spark, sf_dir))


@query(
    f"""{_BACK}, q AS (SELECT *, greatest(n // 4, 1) AS q FROM b),
    s AS (SELECT run, sum(loss / q) FILTER (back <= q) AS l, coalesce(sum(loss / q) FILTER (back > q AND back <= 2 * q), 0) AS p FROM q GROUP BY run)
    SELECT run, round(l, 6) AS last_quarter, round(p, 6) AS previous_quarter, round(l - p, 6) AS trend FROM s"""
)
def quarter_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.quarter_trend(log_points(spark, sf_dir))


@query(f"WITH {LOG} SELECT run, step AS best_step, loss AS best FROM log QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss DESC, step) = 1")
def best_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.best_step(log_points(spark, sf_dir))


@query(
    f"""{_BACK}, s AS (SELECT run, round(avg(loss) FILTER (back <= 3), 6) AS last3, max(loss) AS best, count(*) AS evals FROM b GROUP BY run)
    SELECT w.run, s.last3, s.best, coalesce(s.evals, 0) AS evals, s.evals IS NULL AS missing FROM (VALUES (CAST(0 AS BIGINT)), (1), (-5)) w(run) LEFT JOIN s ON w.run = s.run"""
)
def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.run_table(log_points(spark, sf_dir), spark.createDataFrame([(0,), (1,), (-5,)], "run long"))


@query(f"{_BACK} SELECT run, round(avg(loss) FILTER (at_ <= 20), 6) AS loss_start, round(avg(loss) FILTER (back <= 20), 6) AS loss_end FROM b GROUP BY run")
def loss_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.end_means(log_points(spark, sf_dir))


@query(
    f"""WITH {LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS at_, count(*) OVER (PARTITION BY run) AS n FROM log)
    SELECT run, round(sum(loss * pow(0.99, n - at_) * CASE WHEN at_ = 1 THEN 1 ELSE 0.01 END), 6) AS ema FROM n GROUP BY run"""
)
def running_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.running_ema(log_points(spark, sf_dir))


@query(
    f"""WITH {QUESTIONS}, q AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS rk FROM questions)
    SELECT lang, count(*) AS n, round(avg(CASE WHEN (score > 0) = (truth = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
           round((sum(rk) FILTER (truth = 1) - sum(truth) * (sum(truth) + 1) / 2) / nullif(sum(truth) * (count(*) - sum(truth)), 0), 6) AS auc FROM q GROUP BY lang"""
)
def question_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.question_metrics(question_scores(spark, sf_dir), "lang")


@query(
    f"""WITH {IMAGES}, m AS (SELECT subset, {', '.join(f'stddev_samp(feat[{k}]) AS s{k}, avg(feat[{k}]) AS m{k}' for k in range(1, 65))} FROM images GROUP BY subset)
    SELECT subset, round(sqrt({' + '.join(f's{k} * s{k}' for k in range(1, 65))}) / sqrt({' + '.join(f'm{k} * m{k}' for k in range(1, 65))}), 6) AS spread FROM m"""
)
def relative_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.relative_spread(images(spark, sf_dir), 64, "subset")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.windowed(table(spark, sf_dir, "events"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTES AS "end", count(*) AS n FROM s GROUP BY user_id, session"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(table(spark, sf_dir, "events"))


@query(f"WITH {RUNS}, p AS (SELECT domain, k, condition, avg(mAP) AS m FROM runs GROUP BY ALL) SELECT p.domain, p.k, p.condition, round(p.m - f.m, 6) AS delta FROM p JOIN p f ON p.domain = f.domain AND p.k = f.k AND f.condition = 'first' WHERE round(p.m - f.m, 6) >= 1.0")
def option_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = run_rows(spark, sf_dir).groupBy("domain", "k", "condition").agg(F.avg("mAP").alias("m"))
    ref = per.where("condition = 'first'").select("domain", "k", F.col("m").alias("f"))
    deltas = per.join(ref, ["domain", "k"]).select("domain", "k", "condition", F.round(F.col("m") - F.col("f"), 6).alias("delta"))
    return runs.keep_rule(deltas)


@query(
    f"""WITH {RUNS}, m AS (SELECT domain, split, k, condition, CASE WHEN max(rank1) > 20 THEN max(rank1) / 100 END AS accuracy FROM runs GROUP BY domain, split, k, condition)
    SELECT runs.domain, runs.split, runs.k, runs.condition, runs.draw, round(mAP, 6) AS mAP, coalesce(accuracy, -1) AS accuracy FROM runs JOIN m ON runs.domain = m.domain AND runs.split = m.split AND runs.k = m.k AND runs.condition = m.condition
    WHERE runs.split = 0 AND runs.k = (SELECT max(k) FROM runs) AND runs.condition IN ('true', 'shuffle')"""
)
def prompt_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid rows with made-up question metrics, of those whose prompts are kept; a missing metric is shown as -1."""
    rows, by = run_rows(spark, sf_dir), ["domain", "split", "k", "condition"]
    asked = rows.groupBy(*by).agg((F.max("rank1") / 100).alias("accuracy")).where("accuracy > 0.2").withColumn("auc", F.col("accuracy"))
    kept = runs.banked(runs.grid_rows(rows, asked, by), ("true", "shuffle"))
    return kept.select(*by, "draw", F.round("mAP", 6).alias("mAP"), F.nanvl("llm_acc", F.lit(-1.0)).alias("accuracy"))


_MEANS = "s AS (SELECT condition AS run, avg(mAP) AS score FROM runs GROUP BY condition)"


@query(
    f"""WITH {RUNS}, {_MEANS}, o AS (SELECT max(score) FILTER (run = 'first') AS a, max(score) FILTER (run = 'true') AS b, max(score) FILTER (run = 'own') AS f, max(score) FILTER (run = 'random') AS s FROM s)
    SELECT CASE WHEN b >= a THEN 'true' ELSE 'first' END AS chosen, round(b - a, 6) AS gain, round(f - s, 6) AS full_gain FROM o"""
)
def stage_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = run_rows(spark, sf_dir).groupBy(F.col("condition").alias("run")).agg(F.avg("mAP").alias("score"))
    return runs.stage_decision(scores, "first", "true", "own", "random")


@query(
    f"""WITH {RUNS}, w AS (SELECT domain, split, max(mAP) FILTER (condition = 'own' AND draw = 0) AS own, max(mAP) FILTER (condition = 'first' AND draw = 1) AS first FROM runs GROUP BY domain, split)
    SELECT domain, split, CASE WHEN own IS NOT NULL THEN 'base' WHEN first IS NOT NULL THEN 'fixed' ELSE 'none' END AS origin, round(coalesce(own, first), 6) AS value FROM w"""
)
def first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c, d: F.max(F.when((F.col("condition") == c) & (F.col("draw") == d), F.col("mAP")))
    wide = run_rows(spark, sf_dir).groupBy("domain", "split").agg(of("own", 0).alias("own"), of("first", 1).alias("first"))
    got = wide.select("domain", "split", runs.first_available(("base", F.col("own")), ("fixed", F.col("first"))).alias("v"))
    return got.select("domain", "split", "v.origin", F.round("v.value", 6).alias("value"))
