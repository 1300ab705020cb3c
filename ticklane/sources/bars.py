"""Bar panels: from CSV files of daily bars, and from the line items of the test tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The headers of bar files and their column names.
HEADERS = {
    "日期": "date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "前收": "preclose",
    "成交量": "volume", "成交额": "amount", "换手率": "turnover", "涨跌幅": "pct_chg", "pbMRQ": "pb_mrq", "psTTM": "ps_ttm",
}
NUMBERS = ("open", "high", "low", "close", "preclose", "volume", "amount", "turnover", "pct_chg", "pb_mrq", "ps_ttm")
OHLCV = ("open", "high", "low", "close", "volume")

# Other names under which columns arrive, best first.
ALIASES = {
    "code": ("code", "symbol", "ts_code", "ticker", "证券代码", "股票代码"),
    "date": ("date", "trade_date", "datetime", "日期", "交易日期"),
    "open": ("open", "开盘", "开盘价"),
    "high": ("high", "最高", "最高价"),
    "low": ("low", "最低", "最低价"),
    "close": ("close", "收盘", "收盘价"),
    "preclose": ("preclose", "pre_close", "前收", "昨收"),
    "volume": ("volume", "vol", "成交量"),
    "amount": ("amount", "turnover_value", "成交额"),
    "turnover": ("turnover", "turn", "turnover_rate", "换手率"),
    "pct_chg": ("pct_chg", "pctchg", "change_pct", "涨跌幅"),
}


def _div100(x: Column) -> Column:
    return F.floor(x * F.lit(100.0) + 0.5) / F.lit(100.0)


def bars_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars on an exact-integer random walk: code = l_suppkey, a bar for each day with line items."""
    # dealt by code before they are summed, the line items are exchanged once: sums by (code, date) and windows by code stay there
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").cast("long").alias("code"), F.to_date("l_shipdate").alias("date"), "l_discount", "l_tax", "l_quantity").repartition("code")
    whole = lambda x: F.round(F.col(x) * 100).cast("long")
    days = items.groupBy("code", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(whole("l_discount")).alias("sd"), F.sum(whole("l_tax")).alias("st"), F.max(whole("l_discount")).alias("hx"),
        F.min(whole("l_discount")).alias("mn"), (F.sum(F.col("l_quantity").cast("long")) * 100).alias("volume"))
    line = W.partitionBy("code").orderBy("date")
    step = F.floor((F.col("sd") - 5 * F.col("n")) * F.lit(60.0) / F.col("n")).cast("long")
    df = days.withColumn("cum", F.sum(step).over(line.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("close", F.floor(F.lit(1e4) * F.exp(F.col("cum") / F.lit(1e4)) + 0.5) / F.lit(100.0))
    df = df.withColumn("preclose", F.coalesce(F.lag("close").over(line), F.lit(100.0)))
    df = df.withColumn("open", _div100(F.col("preclose") * (F.lit(1.0) + F.lit(1e-3) * (F.col("st") - 4 * F.col("n")) / F.col("n"))))
    code, close = F.col("code"), F.col("close")
    return df.select(
        "code", "date", "open",
        _div100(F.greatest("open", "close") * (F.lit(1.0) + F.lit(1e-3) * F.col("hx"))).alias("high"),
        _div100(F.least("open", "close") * (F.lit(1.0) - F.lit(1e-3) * F.col("mn"))).alias("low"),
        "close", "preclose", F.col("volume").cast("double").alias("volume"), (F.col("volume") * close).alias("amount"), (F.col("volume") / F.lit(1e6)).alias("turnover"),
        ((close / F.col("preclose") - 1.0) * 100.0).alias("pct_chg"),
        F.when(code % 13 == 0, None).when(code % 11 == 0, -close / 100.0).otherwise(close / (F.lit(20.0) + code % 37)).alias("pb_mrq"),
        F.when(code % 17 == 0, None).otherwise(close / (F.lit(30.0) + code % 23)).alias("ps_ttm"),
    )


def csv_schema(columns: list[str]) -> T.StructType:
    """Everything as text: types are cast with try_cast, so a bad cell is null and not an error."""
    return T.StructType([T.StructField(x, T.StringType()) for x in columns])


def scan_csv(spark: SparkSession, paths: list[str] | str, columns: list[str]) -> DataFrame:
    """Scan of CSV files with a header; columns are the file's headers in order. Paths may be globs; a repeated path is read once."""
    paths = list(dict.fromkeys([paths] if isinstance(paths, str) else paths))
    return spark.read.schema(csv_schema(columns)).option("header", True).csv(paths)


def normalize_cols(df: DataFrame) -> DataFrame:
    """Known headers renamed, missing required columns added as null, dates and numbers cast (bad ones null); other columns stay."""
    df = df.withColumnsRenamed({k: v for k, v in HEADERS.items() if k in df.columns and v not in df.columns})
    for name in ("code", "date", *NUMBERS):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    casts = {x: F.col(x).try_cast("double") for x in NUMBERS}
    return df.withColumns(casts | {"date": F.to_date(F.col("date").try_cast("timestamp"))})


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row, by order, of each key."""
    line = W.partitionBy(*keys).orderBy(*[F.col(x).desc_nulls_last() for x in order])
    return df.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")


def union_dedup(frames: list[DataFrame], keys: tuple[str, ...] = ("code", "date"), order: str | None = None) -> DataFrame:
    """Union by name of files in order; of a key's rows the one in the latest file stays, in a file the last by ``order``."""
    out = None
    for k, frame in enumerate(frames):
        frame = frame.withColumn("_file", F.lit(k))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return dedup_last(out, list(keys), ["_file", *([order] if order else [])]).drop("_file")


def pick_column(columns: list[str], wanted: tuple[str, ...]) -> str | None:
    """The column for a list of names: exact, else whatever the case, else one that contains a name."""
    for match in (lambda x, n: x == n, lambda x, n: x.lower() == n.lower(), lambda x, n: len(n) > 2 and n.lower() in x.lower()):
        for name in wanted:
            for x in columns:
                if match(x, name):
                    return x
    return None


def auto_columns(df: DataFrame, given: dict[str, str] | None = None, required: tuple[str, ...] = ("code", "date", "open", "high", "low", "close")) -> DataFrame:
    """Columns under their standard names, found by ALIASES unless given; a required one that is missing raises."""
    found = {k: (given or {}).get(k) or pick_column(df.columns, names) for k, names in ALIASES.items()}
    missing = [k for k in required if not found.get(k)]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in found.items() if v])


def norm_code(x: Column) -> Column:
    """Digits of a code, padded to 6; null without digits. Longer codes stay as they are."""
    digits = F.regexp_replace(F.upper(F.trim(x)), r"\D", "")
    return F.when(digits == "", None).when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)


def exchange_symbol(x: Column) -> Column:
    """The last dotted part, padded to 6, behind its exchange: sh for 5, 6, 9, bj for 4, 8, else sz."""
    last = F.element_at(F.split(x.cast("string"), r"\."), -1)
    code = F.when(F.length(last) < 6, F.lpad(last, 6, "0")).otherwise(last)
    first = F.substring(code, 1, 1)
    return F.concat(F.when(first.isin("5", "6", "9"), "sh.").when(first.isin("4", "8"), "bj.").otherwise("sz."), code)


def listed(df: DataFrame) -> DataFrame:
    """code, ipo_date of the listed ordinary shares among reference rows (code like sh.600000, type, status, ipoDate): type and
    status "1", the part behind the dot as a 6-digit code, in order; codes of another form are left out, an empty date is null."""
    parts = F.split("code", r"\.")
    rows = df.where((F.col("type") == "1") & (F.col("status") == "1") & (F.size(parts) == 2))
    found = rows.select(norm_code(F.element_at(parts, 2)).alias("code"), F.col("ipoDate").try_cast("date").alias("ipo_date"))
    return found.groupBy("code").agg(F.max("ipo_date").alias("ipo_date")).where(F.col("code").isNotNull()).orderBy("code")


def feature_list(spark: SparkSession, path: str) -> list[str]:
    """The feature names of a text file, a line each, in order; blank lines are skipped, a file without names raises."""
    text = spark.read.text(path, wholetext=True).first()  # one small file, whole, so that lines stay in order
    names = [x.strip() for x in (text.value.splitlines() if text else []) if x.strip()]
    if not names:
        raise ValueError(f"no feature names in {path}")
    return names


def clean_ohlcv(df: DataFrame, narrow: bool = False) -> DataFrame:
    """code, date and prices only; cells that are no numbers are null and incomplete rows go."""
    kind = "float" if narrow else "double"
    out = df.select(F.col("code").cast("string").alias("code"), F.to_date("date").alias("date"), *[F.col(x).try_cast(kind).alias(x) for x in OHLCV])
    return out.dropna(subset=["code", "date", *OHLCV])


def ensure_keys(df: DataFrame) -> DataFrame:
    """code from symbol and date from entry_date where they are missing."""
    for name, other in (("code", "symbol"), ("date", "entry_date")):
        if name not in df.columns and other in df.columns:
            df = df.withColumn(name, F.col(other))
    return df.withColumns({"code": F.col("code").cast("string"), "date": F.to_date("date")})


def pick_strategy_column(df: DataFrame) -> Column:
    """The ledger's strategy column under one of its names, unknown where there is none."""
    name = pick_column(df.columns, ("strategy", "strategy_name", "strat", "signal"))
    return F.coalesce(F.col(name), F.lit("unknown")) if name else F.lit("unknown")


def window_days(columns: list[str]) -> int:
    """Greatest N of columns named dayN_*."""
    return max((int(m[1]) for x in columns if (m := re.match(r"day(\d+)_", x))), default=0)


def numeric_features(df: DataFrame, leave_out: tuple[str, ...] = ("code", "date", "label")) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in leave_out]
