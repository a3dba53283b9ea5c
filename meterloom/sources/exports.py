"""A vendor's own billing export, CSV or JSON, as rows of day, model, cost and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions.amounts import day_of, money, whole

#: Under which names an export's columns are known, the first that it has.
ALIASES = {
    "day": ("day", "date", "usage_date", "timestamp", "start_time", "period", "bucket"),
    "cost": ("cost", "amount", "cost_usd", "amount_usd", "spend", "total_cost", "charge"),
    "model": ("model", "model_name", "sku", "line_item", "description"),
    "tokens": ("tokens", "total_tokens", "token_count", "usage_tokens"),
    "currency": ("currency", "currency_code"),
}


def column_name(header: str) -> str:
    name = header.strip().lower()
    for c in " -.":
        name = name.replace(c, "_")
    return name.strip("_")


def parse_map(spec: str) -> dict[str, str]:
    """``field=column`` pairs, comma-separated, that say which column a field is."""
    out = {}
    for pair in filter(str.strip, spec.split(",")):
        field, _, column = (x.strip() for x in pair.partition("="))
        if not field or not column or column_name(field) not in ALIASES:
            raise ValueError(f"a mapping is one of {', '.join(sorted(ALIASES))} = a column, not {pair!r}")
        out[column_name(field)] = column
    return out


def bind(headers: list[str], mapped: dict[str, str] | None = None) -> dict[str, str]:
    """Which header each field is read from. Day and cost must be there; of headers alike but for spelling the last stands."""
    known = {column_name(h): h for h in headers}
    out = {}
    for field, names in ALIASES.items():
        wanted = [column_name(mapped[field])] if mapped and field in mapped else names
        out |= next(({field: known[n]} for n in wanted if n in known), {})
    if missing := [f for f in ("day", "cost") if f not in out]:
        raise ValueError(f"no column is read as {missing[0]}; map {missing[0]} to one of: {', '.join(headers)}")
    return out


def read_export(spark: SparkSession, path: str, mapped: dict[str, str] | None = None) -> DataFrame:
    """day, model, cost, tokens, currency of each row of an export; a row without a day or an amount that can be read has null in
    both and counts as skipped. All columns are read as text, so nothing is guessed."""
    if path.lower().endswith(".json"):
        rows = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    else:
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return stated(rows, bind(rows.columns, mapped))


def stated(rows: DataFrame, binding: dict[str, str]) -> DataFrame:
    said = lambda field: F.col(f"`{binding[field]}`").cast("string") if field in binding else F.lit(None).cast("string")
    read = rows.select(day_of(said("day")).alias("day"), F.trim(F.coalesce(said("model"), F.lit(""))).alias("model"), money(said("cost")).alias("cost"), whole(said("tokens")).alias("tokens"), F.upper(F.trim(said("currency"))).alias("currency"))
    sound = F.col("day").isNotNull() & F.col("cost").isNotNull()
    return read.withColumns({c: F.when(sound, F.col(c)) for c in read.columns})


def sound(rows: DataFrame) -> DataFrame:
    return rows.where("day IS NOT NULL")


def skipped(rows: DataFrame) -> DataFrame:
    """How many rows an export has and how many could not be read."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("day").isNull()).alias("skipped"))
