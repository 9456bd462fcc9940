"""Writers of nested JSON and of sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_nested_json(df: DataFrame, path: str, key: str) -> None:
    """One JSON record a row, in a folder for each key."""
    df.withColumn(f"{key}_", F.col(key)).write.mode("overwrite").partitionBy(f"{key}_").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays as texts joined by ` | `."""
    return df.select(*(F.array_join(F.col(c).cast("array<string>"), " | ").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes))


def write_csv_semicolon(df: DataFrame, path: str) -> None:
    """A sheet with semicolons and as few quotes as possible; no byte order mark."""
    flat(df).write.mode("overwrite").option("sep", ";").option("header", "true").option("escape", '"').csv(path)


def amount(c: str) -> F.col:
    """Cents as an amount with two decimals. Cents that are a double keep the sign of what was rounded to zero, as printf does: -0.00."""
    whole = (F.col(c).cast("decimal(20,0)") / 100).cast("decimal(18,2)").cast("string")
    return F.when(F.col(c).cast("string") == "-0.0", F.concat(F.lit("-"), whole)).otherwise(whole)


def write_flow_csvs(tables: dict[str, DataFrame], path: str, private: tuple[str, ...] = ("identificacao",)) -> None:
    """Flows, actors, communications and assets as comma sheets: *centavos as amounts with two decimals, private columns left out."""
    for name, df in tables.items():
        money = {c: amount(c) for c in df.columns if c.endswith("centavos")}
        flat(df.drop(*private).withColumns(money)).write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{path}/{name}")
