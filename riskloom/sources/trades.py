"""Trade tables from CSV: reading in file order, roles of columns, and export."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import numbered
from .shared import shared

#: Column that holds the order of the rows of a file.
ORDER = "_order"
#: Rows looked at for numeric columns, and the share of them that must be numbers.
SAMPLE, SHARE = 50, 0.7
#: Strategies that are switched on at once, and how many if there are more.
MOST_ON, FIRST_ON = 8, 4
#: Headers, in small letters, of columns that hold no strategy's results.
NOT_SLEEVES = frozenset({
    "trade number", "instrument", "account", "strategy", "market pos.", "qty", "entry price", "exit price", "entry time", "exit time", "entry name", "exit name",
    "cum. net profit", "commission", "clearing fee", "exchange fee", "ip fee", "nfa fee", "mae", "mfe", "etd", "bars", "",
})


def csv_scan(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with a header, every cell as text, empty lines skipped, with a
    column ORDER that numbers them from 0: files by name, then rows as they stand.

    Spark reads the splits of files by size, in any order, so the number comes from the file,
    the split's begin and the place in the split. Files in which a quoted cell may go over a
    line's end (a line with an odd number of quotes) are read whole, a task each, all others
    in splits."""
    lines = spark.read.text(path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    broken = [r[0] for r in lines.where(odd).select("_metadata.file_path").distinct().collect()]
    file, begin = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")

    def rows(whole: bool) -> DataFrame:
        found = spark.read.csv(path, header=True, inferSchema=False, multiLine=whole, escape='"')
        found = found.where(file.isin(broken) if whole else ~file.isin(broken)) if broken else found
        return found.select("*", file.alias("_file"), begin.alias("_begin"), F.monotonically_increasing_id().alias("_at"))

    found = shared(rows(False).unionByName(rows(True)) if broken else rows(False))
    return numbered(found, [], ["_file", "_begin", "_at"], ORDER).drop("_file", "_begin", "_at")


def csv_export(df: DataFrame, path: str) -> None:
    """Writes ``df`` as CSV files with a header; null cells are empty."""
    df.write.csv(path, header=True, escape='"')


def number(cell: str | Column) -> Column:
    """A number from text such as ``$1,234.5`` or ``($50)``; null if there is none, 0 if
    nothing but currency signs and spaces stands there."""
    raw = F.col(cell) if isinstance(cell, str) else cell
    clean = F.regexp_replace(F.regexp_replace(raw, r"[$,\s]", ""), r"^\((.*)\)$", "-$1")
    value = F.when(clean == "", F.lit(0.0)).when(clean.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), clean.try_cast("double"))
    return F.when(raw.isNull() | (raw == ""), F.lit(None).cast("double")).otherwise(value)


def timestamp(cell: str | Column) -> Column:
    """A time from ISO text, milliseconds since 1970, or ``M/D/YYYY H:MM[:SS]``, in the
    session's time zone; null if it is none of these."""
    raw = F.trim(F.col(cell) if isinstance(cell, str) else cell)
    american = F.coalesce(*(F.try_to_timestamp(F.regexp_replace(raw, "T", " "), F.lit(f)) for f in ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy")))
    return F.when(raw.rlike("^-?[0-9]+$"), F.timestamp_millis(raw.try_cast("long"))).when(raw.contains("/"), american).otherwise(raw.try_cast("timestamp"))


def find_column(df: DataFrame, *candidates: str) -> str | None:
    """The column whose trimmed name equals a candidate, whatever its case; earlier
    candidates first."""
    names = {c.strip().lower(): c for c in reversed(df.columns)}
    return next((names[c.lower()] for c in candidates if c.lower() in names), None)


def find_in_regime_column(df: DataFrame) -> str | None:
    return find_column(df, "in_regime", "in regime")


def is_platform_grid(df: DataFrame) -> bool:
    """Whether the header is that of a trading platform's export."""
    return bool(find_column(df, "profit") and find_column(df, "instrument") and find_column(df, "trade number", "entry time"))


def numeric_columns(df: DataFrame, sample: int = SAMPLE, share: float = SHARE) -> list[str]:
    """Columns that may hold a strategy: at least ``share`` of the first ``sample`` rows
    are numbers, and the name is none of NOT_SLEEVES."""
    names = [c for c in df.columns if c != ORDER and c.strip().lower() not in NOT_SLEEVES]
    if not names:
        return []
    first = df.orderBy(ORDER).limit(sample)
    quoted = ["`" + c.replace("`", "``") + "`" for c in names]
    found = first.agg(*(F.avg(number(F.col(q).cast("string")).isNotNull().cast("double")).alias(f"c{i}") for i, q in enumerate(quoted))).first()
    return [c for c, x in zip(names, found, strict=True) if x is not None and x >= share]


@dataclass(frozen=True)
class Roles:
    """Which columns of a table mean what. ``sleeves``: (column or instrument, weight,
    whether it is on)."""

    pnl: str | None = None
    regime: str | None = None
    time: str | None = None
    benchmark: str | None = None
    benchmark_percent: bool = False
    data_format: str = "absolute"
    commission: float = 0.0
    by_instrument: bool = False
    sleeves: tuple[tuple[str, float, bool], ...] = ()


def grid_roles(df: DataFrame) -> Roles:
    """Roles of a platform's export: results by instrument, in dollars, without commission;
    a sleeve for each instrument with valid trades, by name, of equal weight. Their number
    is that of the instruments of an account, so they are held on the driver."""
    pnl, instrument = find_column(df, "profit") or "Profit", find_column(df, "instrument") or "Instrument"
    valid = df.where(number(pnl).isNotNull() & (F.trim(F.col(instrument)) != "")).select(F.col(instrument).alias("i")).distinct().orderBy("i")
    names = [r["i"] for r in valid.collect()]
    return Roles(pnl, instrument, by_instrument=True, sleeves=tuple((x, 1 / len(names), True) for x in names))


def column_roles(df: DataFrame) -> Roles:
    """Roles of a wide table: the first column is the result of a single strategy; two or
    more numeric ones are sleeves of equal weight, all on up to MOST_ON, else FIRST_ON."""
    names = numeric_columns(df)
    sleeves = () if len(names) < 2 else tuple((c, 1 / len(names), len(names) <= MOST_ON or i < FIRST_ON) for i, c in enumerate(names))
    return Roles(next((c for c in df.columns if c != ORDER), None), sleeves=sleeves)


def roles_of(df: DataFrame) -> Roles:
    found = grid_roles(df) if is_platform_grid(df) else column_roles(df)
    return replace(found, time=find_column(df, "entry time", "timestamp", "time", "date"))


def trades_of(df: DataFrame, roles: Roles) -> DataFrame:
    """The table in the form of every other operator: series_id, trade_idx (without gaps
    from 0), pnl, regime, ts, benchmark. Rows without a number as result are dropped; a
    benchmark in percent is divided by 100, one that is no number is null. With sleeves,
    those that are on are the series: by instrument, or a column each."""
    nothing = F.lit(None)
    bench = number(roles.benchmark) / (100.0 if roles.benchmark_percent else 1.0) if roles.benchmark else nothing.cast("double")
    more = [(F.col(roles.regime) if roles.regime else nothing.cast("string")).alias("regime"), (timestamp(roles.time) if roles.time else nothing.cast("timestamp")).alias("ts"), bench.alias("benchmark"), ORDER]
    on = [name for name, _, on in roles.sleeves if on]
    if not on:
        rows = df.select(F.lit(roles.pnl).alias("series_id"), number(roles.pnl).alias("pnl"), *more)
    elif roles.by_instrument:
        rows = df.where(F.col(roles.regime).isin(on)).select(F.col(roles.regime).alias("series_id"), number(roles.pnl).alias("pnl"), *more)
    else:
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("series_id"), number(F.col("`" + c.replace("`", "``") + "`").cast("string")).alias("pnl")) for c in on))).alias("one")
        rows = df.select(each, *more).select("one.*", "regime", "ts", "benchmark", ORDER)
    return numbered(rows.where("pnl is not null"), ["series_id"], [ORDER], "trade_idx").select("series_id", "trade_idx", "pnl", "regime", "ts", "benchmark")
