"""Readers of JSON lines with comments, load texts and requests; sinks for answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = "text string, entities array<struct<type:string,start:long,end:long>>"
LOAD = "id string, category string, text string"
REQUEST = "operation string, text string, session_id string, mask_context string, route string, dry_run boolean, payload string, payload_id string, texts array<string>"


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Records of a table of lines (value); blank lines and those that begin with # are left out."""
    line = F.trim("value")
    return lines.where((line != "") & ~line.startswith("#")).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_json_lines(spark: SparkSession, path: str, schema: str = LABELLED) -> DataFrame:
    return json_lines(spark.read.text(path), schema)


def inflated(text: Column, tokens_each: Column, tokens: int) -> Column:
    """The text as often, parted by blanks, as it takes to hold about so many tokens."""
    times = F.greatest(F.ceil(F.lit(tokens) / F.greatest(tokens_each, F.lit(1))), F.lit(1)).cast("int")
    return F.array_join(F.array_repeat(text, times), " ")


def load_texts(lines: DataFrame, tokens: int | None = None) -> DataFrame:
    """id, category and text; a missing category is 'default', a missing id the text's hash. With tokens, inflated to them."""
    from ..functions.text import count_tokens_col

    d = json_lines(lines, LOAD).where(F.col("text").isNotNull())
    d = d.withColumns({"id": F.coalesce("id", F.concat(F.lit("item-"), F.sha2("text", 256).substr(1, 8))), "category": F.coalesce("category", F.lit("default"))})
    return d if tokens is None else d.withColumn("text", inflated(F.col("text"), count_tokens_col(F.col("text")), tokens))


def classify_request(d: DataFrame) -> DataFrame:
    """requests with form: batch (texts), correlated (payload and payload_id), explicit (operation and text), else bad_request."""
    form = F.when(F.col("texts").isNotNull(), "batch").when(F.col("payload").isNotNull() & F.col("payload_id").isNotNull(), "correlated")
    return d.withColumn("form", form.when(F.col("operation").isin("mask", "demask") & F.col("text").isNotNull(), "explicit").otherwise("bad_request"))


def error_body(code: Column, message: Column) -> Column:
    """The uniform body of an error."""
    return F.to_json(F.struct(F.struct(code.alias("code"), message.alias("message")).alias("error")))
