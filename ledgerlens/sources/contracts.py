"""Schemas of the inputs, and guards that fail loudly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


def text_schema(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


#: columns and fields of the input files (fixed values)
SUMMARY = text_schema("pdb", "Hchain", "Lchain", "model", "antigen_chain", "antigen_type", "antigen_name", "date", "organism", "heavy_species", "light_species", "antigen_species", "resolution", "method", "heavy_subclass", "light_subclass", "light_ctype")
SUMMARY_OPTIONAL = ("scfv", "engineered")
THERAPEUTICS = text_schema("Therapeutic", "Format", "Highest_Clin_Trial (Feb '25)", "Est. Status", "100% SI Structure", "99% SI Structure", "95-98% SI Structure", "Target", "Genetics (Bispecifics delimited with semicolon)")
SAMPLE = "source string, pdb_id string, paired boolean, target string, heavy struct<sequence_aa:string>, light struct<sequence_aa:string>, coords array<array<float>>, coord_mask array<boolean>, cdr_mask array<boolean>, cdr3_len_actual int, has_antigen boolean, antigen_coords array<array<float>>, antigen_mask array<boolean>, antigen_seq string, interface_mask array<boolean>, antigen_cluster_id string, filename_stem string"
SAMPLE_REQUIRED = ("pdb_id", "paired", "heavy", "cdr_mask", "coord_mask", "has_antigen")
REPERTOIRE = "split string, source_id short, cdr3_len short, clono_hash long, length short, tokens array<short>, cdr_full_mask array<short>"
META_REQUIRED = ("total_samples", "max_len", "source_map", "source_counts")
EXCLUSIONS = text_schema("pdb_id", "stage", "heavy_species", "light_species", "method", "requested_antigen", "detail")


class ContractError(ValueError):
    """An input does not meet its contract."""


def require_columns(df: DataFrame, names: tuple[str, ...] | list[str], what: str) -> DataFrame:
    """The frame, if it has the columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ContractError(f"{what} lacks columns {missing}; it has {df.columns}")
    return df


def require_path(spark: SparkSession, path: str, what: str) -> str:
    """The path, if it exists in any file system that Spark reads."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found):
        raise FileNotFoundError(f"{what} not found: {path}")
    return path


def require_fields(df: DataFrame, required: tuple[str, ...] = SAMPLE_REQUIRED, what: str = "sample") -> DataFrame:
    """Add ``schema_error``: the first required field that is null in a row, else null."""
    from pyspark.sql import functions as F

    require_columns(df, required, what)
    return df.withColumn("schema_error", F.coalesce(*[F.when(F.col(n).isNull(), F.lit(f"missing {n}")) for n in required]))


def check_meta(meta: dict, what: str = "meta") -> dict:
    """The metadata with ``capabilities``; raises where a key is missing."""
    if missing := [k for k in META_REQUIRED if k not in meta]:
        raise ContractError(f"{what} lacks {missing}")
    return meta | {"capabilities": {k: bool(meta.get(k, False)) for k in ("has_clono_hash", "has_cdr3_len")}}


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame, if it has a row; else raises with its columns."""
    if not df.limit(1).count():
        raise ContractError(f"no rows match {what}; columns are {df.columns}")
    return df


def require_count(df: DataFrame, expected: int, what: str) -> DataFrame:
    if (n := df.count()) != expected:
        raise ContractError(f"{what}: {n} rows, expected {expected}")
    return df


def same_schema(metas: list[dict], keys: tuple[str, ...] = ("source_map", "max_len")) -> dict:
    """The first of several splits' metadata, if all agree on the keys."""
    for m in metas[1:]:
        if differ := [k for k in keys if m.get(k) != metas[0].get(k)]:
            raise ContractError(f"splits differ in {differ}")
    return metas[0]
