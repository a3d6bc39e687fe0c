"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def tied(links: DataFrame) -> DataFrame:
    """Links (a, b) that give the same components, most often fewer.

    Each vertex is tied to the smallest of its smaller neighbours, and its other smaller ones are
    tied to that one too. Vertices that have neighbours in common then share all links but one.
    """
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = F.min("b").over(Window.partitionBy("a"))
    return down.withColumn("low", low).select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).distinct()


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, label) for each end of a link (a, b); label is the smallest v that it can reach."""
    links = tied(links)
    both = scratch.write(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), f"{name}-links")
    labels = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "v"), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, "v").groupBy("u").agg(F.min("label").alias("near")).withColumnRenamed("u", "v")
        lower = labels.join(near, "v").select("v", F.least("label", "near").alias("mid"), F.col("label").alias("was"))
        root = labels.select(F.col("v").alias("mid"), F.col("label").alias("far"))
        new = scratch.write(lower.join(root, "mid").select("v", F.least("mid", "far").alias("label"), "was"), f"{name}-{step}")
        changed = new.where("label != was").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("v", "label")
        if not changed:
            scratch.drop(f"{name}-links")
            return labels
