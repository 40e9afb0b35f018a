"""Studies of many runs: preparation ladders, feature tables, experiment arms and their reports, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lattiq.operators import profile
from lattiq.operators.selection import percentiles
from lattiq.operators.stats import long_form
from lattiq.operators.windows import saturation

STRATEGIES = ("full", "scale-only", "none")

#: Budgets in exposures a sample of the three regimes, and the mean percentage of the growing batches.
DET_BUDGETS = (3, 10, 30, 100, 300, 1000)
STOCH_BUDGETS = (1, 3, 10, 30, 100, 300, 1000)
HYB_BUDGETS = (3, 10, 30, 100, 300, 1000)
HYB_MEAN_PERCENT = 3.0


def prepare_by_strategy(df: DataFrame, id_col: str, strategy: str = "full", max_categories: int = 30, noise_ratio: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(features, mask) by one of three strategies; gaps are filled and text is encoded in all of them.

    full: columns of noise go, missing cells are masked, values are scaled. scale-only: every column stays and nothing
    is masked. none: neither mask nor scale.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {STRATEGIES}")
    cols = [c for c in df.columns if c != id_col]
    if strategy == "full":
        noise = {r["column"] for r in profile.profile_columns(df, id_col, max_categories, noise_ratio).where("is_noise").select("column").collect()}  # one row a column
        cols = [c for c in cols if c not in noise]
    gaps = profile.ignore_mask(df, cols, None).columns
    mask = df.select(id_col, *[(F.col(c).isNull() if strategy == "full" else F.lit(False)).alias(m) for c, m in zip(cols, gaps, strict=True)])
    filled = profile.fill_missing(df.select(id_col, *cols), cols)
    codes = profile.encode_labels(filled, [c for c in cols if not profile.is_numeric(df, c)])
    if strategy != "none":
        codes = profile.min_max_scale(codes, cols)
    return codes.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols]), mask


def feature_columns(numeric: list[str], schema: dict[str, list[str]]) -> list[str]:
    return [*numeric, *[f"{c}_{v}" for c, values in schema.items() for v in values]]


def candidates(results: DataFrame, numeric: list[str], schema: dict[str, list[str]], targets: list[str], dataset: str = "dataset_name", penalised: str = "is_penalized", keep_penalised: bool = False, keep_unknown: bool = False) -> DataFrame:
    """(dataset, features, targets) before rows with gaps go.

    Penalised rows go unless kept; an unknown flag is not penalised. Values outside the fixed *schema* would be zeros
    in every one-hot column, so their rows go too unless kept. A missing target column is an error; without
    a data set column the name is unknown.
    """
    missing = [c for c in [*numeric, *schema, *targets] if c not in results.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    rows = results
    if not keep_penalised and penalised in rows.columns:
        rows = rows.where(~F.coalesce(F.col(penalised).cast("boolean"), F.lit(False)))
    if not keep_unknown:
        for c, values in schema.items():
            rows = rows.where(F.col(c).isin(values))
    name = F.coalesce(F.col(dataset).cast("string"), F.lit("unknown")) if dataset in rows.columns else F.lit("unknown")
    hot = [one for c, values in schema.items() for one in profile.one_hot(F.col(c), c, values)]
    return rows.select(name.alias("dataset_name"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in numeric], *hot, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in targets])


def feature_table(results: DataFrame, numeric: list[str], schema: dict[str, list[str]], targets: list[str], **options) -> DataFrame:
    """The table a model is trained on: no gaps, fixed columns in a fixed order."""
    return candidates(results, numeric, schema, targets, **options).dropna()


def feature_metadata(results: DataFrame, numeric: list[str], schema: dict[str, list[str]], targets: list[str], **options) -> DataFrame:
    """One row on the table: samples, dropped rows, and its columns; one scan."""
    rows = candidates(results, numeric, schema, targets, **options)
    whole = F.lit(True)
    for c in [*numeric, *targets]:
        whole = whole & F.col(c).isNotNull()
    names = feature_columns(numeric, schema)
    return rows.agg(F.count_if(whole).alias("num_samples"), F.count_if(~whole).alias("dropped_rows"), F.count_distinct("dataset_name").alias("datasets")).select(
        "*", F.lit(len(names)).alias("num_features"), F.lit(len(targets)).alias("num_targets"), F.array(*map(F.lit, names)).alias("feature_columns")
    )


def arms(sizes: DataFrame, samples: str) -> DataFrame:
    """The experiment grid of each data set of *sizes*: (columns, arm, regime, budget, epoch_multiplier, start_percent, end_percent, growth).

    A multiplier carries half an iteration more than wanted, so that cutting off its product with the size lands on it.
    """
    n = F.col(samples)

    def arm(regime: str, tag: str, budget: int, multiplier: Column, start: float, end: float, growth: str) -> Column:
        return F.struct(
            F.lit(f"{regime}-{tag}{budget}").alias("arm"), F.lit(regime).alias("regime"), F.lit(budget).alias("budget"), multiplier.cast("double").alias("epoch_multiplier"),
            F.lit(start).alias("start_percent"), F.lit(end).alias("end_percent"), F.lit(growth).alias("growth"),
        )

    grid = [arm("det", "e", b, (b + 0.5) / n, 100.0, 100.0, "static") for b in DET_BUDGETS]
    grid += [arm("stoch", "em", b, F.lit(float(b)), 0.01, 0.01, "static") for b in STOCH_BUDGETS]
    grid += [arm("hyb", "b", b, (round(b * 100 / HYB_MEAN_PERCENT) + 0.5) / n, 1.0, 5.0, "linear-growth") for b in HYB_BUDGETS]
    return sizes.where(n > 0).select("*", F.explode(F.array(*grid)).alias("_a")).select(*sizes.columns, "_a.*")


def parse_arm(name: Column, prefix: str = "arm_") -> tuple[Column, Column]:
    """(regime, budget) of a run's folder name; null for a foreign one."""
    pattern = f"^{prefix}(det|stoch|hyb)-[^0-9]*([0-9]{{1,9}})$"
    known = F.regexp_like(name, F.lit(pattern))
    return F.when(known, F.regexp_extract(name, pattern, 1)), F.when(known, F.regexp_extract(name, pattern, 2).try_cast("int"))


def arm_report(runs: DataFrame, dataset: str, folder: str, metrics: list[str], prefix: str = "arm_", least: float = 0.02) -> DataFrame:
    """(dataset, regime, budget, metric, n, p25, median, p75, gain, saturated) of all runs of an arm.

    Percentiles are exact. The gain is what the median falls by up to the next budget; a budget is saturated if no later
    step gains *least*. Rows of foreign folders are left out.
    """
    regime, budget = parse_arm(F.col(folder), prefix)
    rows = runs.select(F.col(dataset).alias("dataset"), regime.alias("regime"), budget.alias("budget"), *metrics).where("regime IS NOT NULL")
    keys = ["dataset", "regime", "budget", "metric"]
    long = long_form(rows, ["dataset", "regime", "budget"], metrics).withColumnRenamed("feature", "metric")
    count = long.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    q = percentiles(long, keys, "value", [0.25, 0.5, 0.75])
    both = q.join(count, [q[k].eqNullSafe(count[f"_{k}"]) for k in keys]).select(*keys, "n", *[F.round(F.col("q")[k], 4).alias(name) for k, name in enumerate(("p25", "median", "p75"))])
    gains = saturation(both.withColumn("_m", F.nullif("median", F.lit(0.0))), ["dataset", "regime", "metric"], "budget", "_m", least)
    return gains.select(*keys, "n", "p25", "median", "p75", F.round("gain", 6).alias("gain"), "saturated")


def advice(results: DataFrame, generations: DataFrame, uid: str, flag: str, penalised: str, ratio: str, values: list[str]) -> DataFrame:
    """(rule, figure, out_of): what the results of a search suggest; only rules that hold.

    flag_always_penalised: at least 95 % of the rows with the flag are. high_penalty_rate: more than half of the known
    ratios are 2 or more. archive_regression: the last generation (generation, ratio) holds fewer ratios below 1 than the
    best one did. nondeterministic: uids whose repeated rows differ in a value; duplicates: repeated rows, if none differ.
    """
    share = results.agg(
        F.count_if(F.col(flag)).alias("flagged"), F.count_if(F.col(flag) & F.col(penalised)).alias("hit"), F.count(ratio).alias("known"), F.count_if(F.col(ratio) >= 2).alias("worse")
    )
    rule = F.array(
        F.when((F.col("flagged") > 0) & (F.col("hit") >= 0.95 * F.col("flagged")), F.struct(F.lit("flag_always_penalised").alias("rule"), F.col("hit").alias("figure"), F.col("flagged").alias("out_of"))),
        F.when(F.col("worse") > 0.5 * F.col("known"), F.struct(F.lit("high_penalty_rate").alias("rule"), F.col("worse").alias("figure"), F.col("known").alias("out_of"))),
    )
    out = share.select(F.inline(F.array_compact(rule)))
    good = generations.groupBy("generation").agg(F.count_if(F.col("ratio") < 1).alias("good"))
    ends = good.agg(F.max("good").alias("peak"), F.max_by("good", "generation").alias("final"))
    out = out.unionByName(ends.where("peak > final").select(F.lit("archive_regression").alias("rule"), F.col("final").alias("figure"), F.col("peak").alias("out_of")))
    differ = F.lit(False)
    for v in values:
        differ = differ | F.coalesce(F.min(v) < F.max(v), F.lit(False))
    twice = results.groupBy(uid).agg(F.count(F.lit(1)).alias("n"), differ.alias("differ")).where("n > 1")
    seen = twice.agg(F.count_if("differ").alias("differ"), F.sum(F.col("n") - 1).alias("extra"), F.count(F.lit(1)).alias("uids")).where("uids > 0")
    named = F.when(F.col("differ") > 0, F.struct(F.lit("nondeterministic").alias("rule"), F.col("differ").alias("figure"), F.col("uids").alias("out_of"))).otherwise(F.struct(F.lit("duplicates").alias("rule"), F.col("extra").alias("figure"), F.col("uids").alias("out_of")))
    return out.unionByName(seen.select(named.alias("r")).select("r.*"))
