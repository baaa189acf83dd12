"""Readers of data sets: delimited files with and without a description, namespaced text, raw dumps, Parquet."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Dataset:
    """Rows of text columns, and what is known of them."""

    rows: DataFrame
    columns: list[str]
    numeric: set[str] = field(default_factory=set)
    namespaces: dict[str, str] = field(default_factory=dict)


def text_of(spark: SparkSession, path: str) -> str:
    """A small side file, through Spark's file systems."""
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _csv(spark: SparkSession, path: str, names: Sequence[str] | None, sep: str = ",", encoding: str = "ISO-8859-1") -> DataFrame:
    read = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("escape", '"').option("inferSchema", False)
    if names:
        read = read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("enforceSchema", True)
    return read.option("mode", "DROPMALFORMED").csv(path).fillna("")  # an empty field is an empty string


def read_csv_raw(spark: SparkSession, folder: str) -> Dataset:
    """data.csv with a header line; nothing is numeric."""
    rows = _csv(spark, f"{folder}/data.csv", None)
    return Dataset(rows, rows.columns)


def read_described_csv(spark: SparkSession, folder: str) -> Dataset:
    """data.csv, columns and types from dataset_desc.json; numeric where the type has float in it."""
    found = json.loads(text_of(spark, f"{folder}/dataset_desc.json"))["data_features"]
    names = [f["name"] for f in found]
    return Dataset(_csv(spark, f"{folder}/data.csv", names), names, {f["name"] for f in found if "float" in f["type"].lower()})


def read_namespaces(spark: SparkSession, path: str) -> tuple[set[str], dict[str, str]]:
    """(numeric features, id to feature) of lines id,feature or id,feature,type; others are skipped."""
    numeric, names = set(), {}
    for line in text_of(spark, path).splitlines():
        parts = line.strip().split(",")
        if len(parts) == 2 and "_" not in parts[0] or len(parts) == 3:
            names[parts[0]] = parts[1]
            if len(parts) == 3 and parts[2] == "f32":
                numeric.add(parts[1])
    return numeric, names


def namespaced_columns(line: Column, columns: Sequence[str], namespaces: dict[str, str], keep_prefix: bool = False) -> list[Column]:
    """Columns of a line ``label |ns token token |ns token``: label, then each namespace's tokens joined by '-'.

    Values lose their first two characters unless ``keep_prefix``; absent namespaces are null.
    """
    parts = F.split(line, r"\|")
    label = F.get(F.split(F.trim(F.get(parts, F.lit(0))), " "), F.lit(0))
    of = {v: k for k, v in namespaces.items()}
    out = [label.alias("label")]
    for c in columns:
        if c == "label":
            continue
        part = F.get(F.filter(F.slice(parts, 2, 1 << 20), _starts_with(of.get(c, ""))), F.lit(0))
        tokens = F.filter(F.slice(F.split(F.trim(part), " "), 2, 1 << 20), lambda t: t != "")
        value = F.array_join(tokens, "-")
        out.append((value if keep_prefix else F.substring(value, 3, 1 << 20)).alias(c))
    return out


def _starts_with(name: str):
    return lambda p: F.split_part(F.trim(p), F.lit(" "), F.lit(1)) == name


def read_namespaced(spark: SparkSession, folder: str, keep_prefix: bool = False) -> Dataset:
    """vw_namespace_map.csv and data.vw.gz, or else .zst or plain; the first line is skipped."""
    numeric, names = read_namespaces(spark, f"{folder}/vw_namespace_map.csv")
    columns = ["label", *names.values()]
    path = next((p for p in (f"{folder}/data.vw.gz", f"{folder}/data.vw.zst", f"{folder}/data.vw") if _exists(spark, p)), None)
    if path is None:
        raise FileNotFoundError(f"no data.vw in {folder}")
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n")).filter("n > 0")
    return Dataset(lines.select(*namespaced_columns(F.col("value"), columns, names, keep_prefix)), columns, numeric, names)


def read_raw_dump(spark: SparkSession, folder: str) -> Dataset:
    """TSV parts raw_data/1_train/*/*, each with a line to skip; names from raw_data/0_header/header.csv."""
    names = text_of(spark, f"{folder}/raw_data/0_header/header.csv").splitlines()[0].split("\t")
    return Dataset(_csv(spark, f"{folder}/raw_data/1_train/*/*", names, "\t", "UTF-8"), names)


def read_parquet(spark: SparkSession, path: str) -> Dataset:
    rows = spark.read.parquet(path)
    return Dataset(rows, rows.columns, {c for c, t in rows.dtypes if t in ("float", "double")})


SOURCES = {"csv-raw": read_csv_raw, "ob-csv": read_described_csv, "ob-vw": read_namespaced, "ob-raw-dump": read_raw_dump, "parquet": read_parquet}


def read(spark: SparkSession, source: str, path: str) -> Dataset:
    """Reads by the name of a layout; an unknown one is a NotImplementedError."""
    if source not in SOURCES:
        raise NotImplementedError(f"no source is called {source}")
    return SOURCES[source](spark, path)


def split_lines(lines: DataFrame, names: Sequence[str], sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(rows of lines with as many fields as names, the lines with others); trailing white space is cut first."""
    parts = F.split(F.trim("value"), sep)
    lines = lines.withColumn("__p", parts)
    good = lines.filter(F.size("__p") == len(names)).select(*(F.get("__p", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return good, lines.filter(F.size("__p") != len(names)).select("value")


def reference_features(spark: SparkSession, path: str, combined_only: bool = False, all_features: bool = False) -> set[str]:
    """Features of a reference model {"desc": {"features": [...], "fields": [...]}}: its elements, its crosses, or all."""
    desc = json.loads(text_of(spark, path))["desc"]
    listed = list(desc.get("features", []))
    if all_features:
        return set(listed)
    if combined_only:
        return {f for f in listed if "," in f}
    return {p for f in [*listed, *desc.get("fields", [])] for p in f.split(",")}


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """pairwise_ranks.tsv, best first."""
    return spark.read.schema("FeatureA string, FeatureB string, Score double").csv(path, sep="\t", header=True).orderBy(F.desc("Score"))
