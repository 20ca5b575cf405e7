"""Sinks: CSV exports of results, statistics and tables (SNK)."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, compression: str = "lz4", mode: str = "errorifexists") -> None:
    """The native store; an existing table is never replaced unasked."""
    df.write.mode(mode).option("compression", compression).parquet(path)


def export_csv(df: DataFrame, path: str, missing: str = "") -> None:
    """Distributed CSV with a header; nulls become the given text. Map columns go to side tables
    <path>_metric_<column>."""
    maps = [c for c, kind in df.dtypes if kind.startswith("map")]
    for c in maps:
        df.select(F.explode(c)).write.mode("overwrite").option("header", True).csv(f"{path}_metric_{c}")
    df.drop(*maps).write.mode("overwrite").option("header", True).option("nullValue", missing).csv(path)


def export_columns(columns: dict[str, list], path: str) -> None:
    """Small driver-side lists of unequal length as one CSV; shorter ones are filled up with ''."""
    path = path if path.endswith(".csv") else path + ".csv"
    longest = max(map(len, columns.values()), default=0)
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(columns)
        writer.writerows([[v[i] if i < len(v) else "" for v in columns.values()] for i in range(longest)])


def export_folds(folds: DataFrame, metrics: list[str], path: str, index: str = "fold") -> None:
    """The average of each metric, then one line a fold (a few rows: one for each fold)."""
    rows = folds.orderBy(index).select(*metrics).collect()
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(["Average"])
        writer.writerow(metrics)
        writer.writerow([sum(r[i] for r in rows) / len(rows) for i in range(len(metrics))] if rows else [])
        writer.writerow(["Steps"])
        writer.writerow(["NR.", *metrics])
        writer.writerows([[i, *r] for i, r in enumerate(rows)])


def export_predictions(predicted: DataFrame, path: str) -> None:
    predicted.select(F.col("y").alias("True_values"), F.col("p").alias("Predicted_values")).write.mode("overwrite").option("header", True).csv(path)


def export_statistics(summary: DataFrame, distribution: DataFrame, path: str) -> None:
    """Duplicate statistics as JSON; the distribution has one entry for each group size."""
    out = summary.first().asDict() | {"duplicates_dist": {str(r["size"]): r["groups"] for r in distribution.orderBy("size").collect()}}
    Path(path).write_text(json.dumps(out))
