"""SMILES files: one structure a line, with an optional name; lines that are blank or start with # are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_smiles(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """smiles, name (null if there is none); fields are parted by white space or the delimiter (a pattern)."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(~F.col("line").rlike(r"^(#|$)"))
    parts = F.split("line", delimiter or r"\s+", 2)
    return lines.select(parts[0].alias("smiles"), F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("name"))


def write_smiles(df: DataFrame, path: str, smiles: str = "smiles", name: str | None = None) -> None:
    """A line a row, null structures left out."""
    cols = [F.col(smiles)] + ([F.col(name)] if name else [])
    df.where(F.col(smiles).isNotNull()).select(F.concat_ws(" ", *cols).alias("value")).write.mode("overwrite").text(path)


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """name, block, properties (map) of each record of SD files; records end with a line of four dollars."""
    records = spark.read.option("lineSep", "$$$$\n").text(path).where(F.trim("value") != "")
    pairs = F.regexp_extract_all("value", F.lit(r"(?m)^>[^\n]*<([^>\n]+)>[^\n]*\n"), F.lit(1))
    values = F.regexp_extract_all("value", F.lit(r"(?m)^>[^\n]*<[^>\n]+>[^\n]*\n((?:[^\n]+\n?)*)"), F.lit(1))
    props = F.map_from_arrays(F.transform(F.array_distinct(pairs), lambda k: k), F.transform(F.array_distinct(pairs), lambda k: F.rtrim(F.element_at(values, F.array_position(pairs, k).cast("int")), F.lit("\n"))))
    return records.select(F.trim(F.split("value", "\n")[0]).alias("name"), F.split("value", r"(?m)^M  END")[0].alias("block"), props.alias("properties"))


def write_sdf(df: DataFrame, path: str, block: str = "block", properties: str | None = None) -> None:
    """A record a row: the connection block (with its end or without), its end, the properties (a map) in order of their names; rows without a block are left out.

    Null properties are left out. Blank lines within a value would end it, so they are removed.
    """
    body = F.concat(F.rtrim(F.split(F.col(block), r"(?m)^M  END")[0], F.lit("\n")), F.lit("\nM  END\n"))
    if properties:
        named = F.array_sort(F.map_entries(F.map_filter(F.coalesce(F.col(properties), F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())))
        one = lambda e: F.concat(F.lit("> <"), e["key"], F.lit(">\n"), F.regexp_replace(e["value"], r"\n\s*(?=\n|$)", ""), F.lit("\n\n"))
        body = F.concat(body, F.array_join(F.transform(named, one), ""))
    df.where(F.col(block).isNotNull()).select(body.alias("value")).write.mode("overwrite").option("lineSep", "$$$$\n").text(path)


def read_table(spark: SparkSession, path: str, smiles: str = "smiles", activity: str | None = None, delimiter: str = ",") -> DataFrame:
    """CSV files with a header: all columns as text, the activity as a number, null where it isn't one."""
    df = spark.read.option("header", True).option("sep", delimiter).option("escape", '"').csv(path)
    if smiles not in df.columns:
        raise ValueError(f"no column {smiles}")
    return df if activity is None else df.withColumn(activity, F.expr(f"try_cast(`{activity}` AS double)"))
