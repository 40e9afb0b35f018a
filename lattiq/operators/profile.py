"""Column profiling, classification, and encoding of tables for a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lattiq.operators.selection import percentiles
from lattiq.operators.sequences import positions
from lattiq.operators.stats import long_form

NUMERIC = (T.NumericType, T.BooleanType)


def validate_input(df: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Projection to *selected*; a missing column or an empty table is an error."""
    if selected:
        missing = sorted(set(selected) - set(df.columns))
        if missing:
            raise ValueError(f"missing columns: {missing}")
        df = df.select(*selected)
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, NUMERIC)


def profile_columns(df: DataFrame, primary_id: str | None = None, max_categories: int = 30, noise_ratio: float = 0.2) -> DataFrame:
    """One row a column: nunique, ratio, base type, class and status, from one aggregate."""
    cols = df.columns
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("rows"), *[F.count_distinct(c).alias(f"u{k}") for k, c in enumerate(cols)])
    kinds = F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*[F.lit("numeric" if is_numeric(df, c) else "text") for c in cols]))
    longer = wide.select("rows", F.explode(F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*[f"u{k}" for k in range(len(cols))]))).alias("column", "nunique"))
    ratio = F.round(F.col("nunique") / F.greatest(F.col("rows"), F.lit(1)), 6)
    text, is_id = F.col("base_type") == "text", F.col("column") == F.lit(primary_id or "")
    noise = text & (F.col("nunique_ratio") > noise_ratio) & ~is_id
    categorical = (F.col("nunique") <= max_categories) & ~noise & ~is_id
    return longer.select(
        "column", "nunique", ratio.alias("nunique_ratio"), kinds[F.col("column")].alias("base_type")
    ).select(
        "*",
        noise.alias("is_noise"),
        categorical.alias("is_categorical"),
        F.when(is_id, "primary_id").when(noise, "ignored").otherwise("used").alias("status"),
    )


def infer_primary_id(profile: DataFrame, columns: list[str], least: float = 0.99) -> str | None:
    """The first column, in table order, that is nearly unique."""
    unique = {r["column"] for r in profile.where(F.col("nunique_ratio") >= least).select("column").collect()}
    return next((c for c in columns if c in unique), None)


def split_groundtruth(df: DataFrame, id_col: str = "id", max_labels: int = 50) -> DataFrame:
    """Numeric columns of a ground truth as labels (integers with few values) or parameters."""
    cols = [c for c in df.columns if c != id_col and is_numeric(df, c)]
    whole = {c: isinstance(df.schema[c].dataType, T.IntegralType) for c in cols}
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in cols]).unpivot([], cols, "column", "nunique")
    integral = F.col("column").isin([c for c in cols if whole[c]])
    return counts.withColumn("role", F.when(integral & (F.col("nunique") <= max_labels), "label").otherwise("parameter"))


def ignore_mask(df: DataFrame, cols: list[str], id_col: str | None = None) -> DataFrame:
    """True where a cell is invisible: null, or of the id column."""
    return df.select(*[(F.lit(True) if c == id_col else F.col(c).isNull()).alias(f"m_{c}") for c in cols], *([id_col] if id_col else []))


def fill_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact median for numeric columns, the empty string for text."""
    numeric = [c for c in cols if is_numeric(df, c)]
    if numeric:
        found = percentiles(long_form(df, [], numeric), ["feature"], "value", [0.5])
        medians = found.agg(*[F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(f"_{c}") for c in numeric])
        df = df.join(F.broadcast(medians))  # one row
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")) if c in numeric else F.coalesce(c, F.lit("")) for c in cols}
    return df.withColumns(filled).drop(*[f"_{c}" for c in numeric])


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): rank of each distinct value in sorted order, from zero."""
    values = df.select(F.col(col).alias("value")).where("value IS NOT NULL").distinct()
    return positions(values, ["value"]).select("value", F.col("position").cast("int").alias("code"))


def encode_labels(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace values by their codes. The code tables of categorical columns are small; Spark picks the join."""
    for c in cols:
        codes = label_codes(df, c).select(F.col("value").alias(f"_{c}"), F.col("code").alias(f"_code_{c}"))
        df = df.join(codes, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.col(f"_code_{c}")).drop(f"_{c}", f"_code_{c}")
    return df


def min_max_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes zero."""
    spans = df.agg(*[f(F.col(c).cast("double")).alias(f"_{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max))])
    wide = df.join(F.broadcast(spans))  # one row
    lo, hi = ({c: F.col(f"_{k}_{c}") for c in cols} for k in ("lo", "hi"))
    scaled = {c: F.when(F.col(c).isNotNull(), F.when(hi[c] > lo[c], (F.col(c) - lo[c]) / (hi[c] - lo[c])).otherwise(0.0)) for c in cols}
    return wide.withColumns(scaled).drop(*[f"_{k}_{c}" for c in cols for k in ("lo", "hi")])


def zero_masked_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns without any value become zero."""
    seen = df.agg(*[F.count(c).alias(f"_{c}") for c in cols])
    return df.join(F.broadcast(seen)).withColumns({c: F.when(F.col(f"_{c}") == 0, F.lit(0.0)).otherwise(F.col(c)) for c in cols}).drop(*[f"_{c}" for c in cols])


def dataset_stats(df: DataFrame, numeric: list[str], categorical: list[str], ignored: list[str], strategy: str = "full") -> DataFrame:
    """One row of ds_* statistics; missing cells are counted before any fill as well."""
    cols = numeric + categorical
    missing = sum((F.sum(F.col(c).isNull().cast("long")) for c in cols), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("ds_n_samples"),
        missing.cast("long").alias("ds_n_missing_before_fill"),
        *[F.count_distinct(c).alias(f"_{c}") for c in categorical],
    ).select(
        "ds_n_samples",
        F.lit(len(cols)).alias("ds_n_dims"),
        F.lit(len(numeric)).alias("ds_n_numeric"),
        F.lit(len(categorical)).alias("ds_n_categorical"),
        F.lit(len(ignored)).alias("ds_n_ignored"),
        "ds_n_missing_before_fill",
        F.round(F.col("ds_n_missing_before_fill") / (F.col("ds_n_samples") * max(1, len(cols))), 6).alias("ds_missing_ratio"),
        F.round(F.lit(len(categorical) / max(1, len(cols))), 6).alias("ds_categorical_ratio"),
        (F.greatest(*[F.col(f"_{c}") for c in categorical], F.lit(0)) if categorical else F.lit(0)).cast("long").alias("ds_max_cardinality"),
        F.round(sum((F.col(f"_{c}") for c in categorical), F.lit(0)) / max(1, len(categorical)), 6).alias("ds_mean_cardinality"),
        F.lit(strategy).alias("ds_preprocess_strategy"),
    )


def one_hot(col: Column, name: str, values: list[str]) -> list[Column]:
    """Fixed one-hot columns; unknown values give zeros."""
    return [F.coalesce((col == v).cast("int"), F.lit(0)).alias(f"{name}_{v}") for v in values]


def quality_score(df: DataFrame, mqe: str, te: str, dead: str) -> DataFrame:
    """Weighted quality of min-max scaled metrics, in [0, 1]; missing scores take the median."""
    scaled = min_max_scale(df.withColumns({"_m": F.col(mqe), "_t": F.col(te), "_d": F.col(dead)}), ["_m", "_t", "_d"])
    raw = 0.5 * (1 - F.col("_m")) + 0.3 * (1 - F.col("_t")) + 0.2 * (1 - F.col("_d"))
    scored = scaled.withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).drop("_m", "_t", "_d")
    middle = scored.agg(F.percentile("quality", 0.5).alias("_q"))
    return scored.join(F.broadcast(middle)).withColumn("quality", F.round(F.coalesce("quality", "_q"), 6)).drop("_q")


def rule_label(te: Column, dead: Column) -> tuple[Column, Column]:
    """(label, source) of the labelling rules; no rule gives null."""
    label = F.when(dead > 0.30, 0.1).when(te > 0.50, 0.1).when((dead < 0.05) & (te < 0.10), 0.9)
    source = F.when(dead > 0.30, "auto_dead").when(te > 0.50, "auto_te").when((dead < 0.05) & (te < 0.10), "auto_good")
    return label, source


def pseudo_label(p: Column, margin: float = 0.15) -> Column:
    """The prediction where it is far enough from one half."""
    return F.when(F.abs(p - 0.5) >= margin, p)


def mask_summary(df: DataFrame, cols: list[str], id_col: str, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(missing by column, most incomplete rows)."""
    by_col = df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    by_col = by_col.unpivot(["rows"], cols, "column", "missing").withColumn("always_masked", F.col("missing") == F.col("rows"))
    missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    rows = df.select(id_col, missing.alias("missing")).where("missing > 0").orderBy(F.desc("missing"), id_col).limit(top)
    return by_col, rows
