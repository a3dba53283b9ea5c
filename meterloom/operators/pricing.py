"""Public prices, model names and what a row of tokens costs. A model without a price has no cost, which is not a cost of zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.plans.bridge import PRICE_COLUMNS, PRICES

PREMIUM = 2e-5  # dollars an output token from which a model is premium


def prices(spark: SparkSession, table=PRICES) -> DataFrame:
    """A table of prices; a missing one-hour rate is the cache-write rate."""
    rows = [(m, a, b, c, c if d is None else d, e) for m, a, b, c, d, e in table]
    return spark.createDataFrame(rows, f"{PRICE_COLUMNS[0]} string, " + ", ".join(f"{c} double" for c in PRICE_COLUMNS[1:]))


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """A price file: one JSON object of models, each with its costs a token."""
    rate = "struct<input_cost_per_token:double,output_cost_per_token:double,cache_creation_input_token_cost:double,cache_creation_input_token_cost_above_1hr:double,cache_read_input_token_cost:double>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{rate}>")).alias("price_model", "r"))
    write = F.coalesce("r.cache_creation_input_token_cost", F.lit(0.0))
    return whole.select("price_model", F.coalesce("r.input_cost_per_token", F.lit(0.0)).alias("p_in"), F.coalesce("r.output_cost_per_token", F.lit(0.0)).alias("p_out"), write.alias("p_write"), F.coalesce("r.cache_creation_input_token_cost_above_1hr", write).alias("p_write_1h"), F.coalesce("r.cache_read_input_token_cost", F.lit(0.0)).alias("p_read"))


def normalized(model: Column) -> Column:
    """A model's name without a trailing bracket or date, in lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(model), r"\[[^\]]*\]$", "")), r"-[0-9]{8}$", "")


def priced(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds the prices of each row's model, by its exact name, else its normalised one; null where neither is known. Price tables hold
    thousands of models at most; Spark broadcasts what it measures as small."""
    by_name = table.select(*(F.col(c).alias(f"x_{c}") for c in PRICE_COLUMNS))
    joined = rows.join(by_name, F.col("model") == F.col("x_price_model"), "left").withColumn("plain_model", normalized(F.col("model")))
    joined = joined.join(table, F.col("plain_model") == F.col("price_model"), "left")
    return joined.select(*rows.columns, *(F.coalesce(f"x_{c}", c).alias(c) for c in PRICE_COLUMNS))


def cost() -> Column:
    """Dollars of a priced row. The one-hour part of the cache writes can't be more than all of them."""
    hour = F.least(F.greatest(F.col("cache_write_1h"), F.lit(0)), F.greatest(F.col("cache_write_tokens"), F.lit(0)))
    return F.col("input_tokens") * F.col("p_in") + F.col("output_tokens") * F.col("p_out") + (F.col("cache_write_tokens") - hour) * F.col("p_write") + hour * F.col("p_write_1h") + F.col("cache_read_tokens") * F.col("p_read")


def tokens() -> Column:
    """Tokens of a row; reasoning and one-hour writes are parts of others and are not added again."""
    return F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
