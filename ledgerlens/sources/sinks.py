"""Sinks: tables, JSON sections, Markdown, FASTA, versioned rewrites and caches."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.contracts import ContractError
from ledgerlens.sources.readers import read_json_object


def write_table(df: DataFrame, path: str, form: str = "parquet", **options: str) -> None:
    df.write.mode("overwrite").options(**options).format(form).save(path)


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in any file system that Spark writes."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def plain(value):
    """JSON without NaN: not-finite numbers are null, other types become text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (str, int, bool)) else str(value)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_text_file(spark, path, json.dumps(plain(value), indent=2, sort_keys=True) + "\n")


def merge_json(spark: SparkSession, path: str, sections: dict) -> dict:
    """Replace the given sections of a report and keep the others."""
    merged = (read_json_object(spark, path) or {}) | sections
    write_json(spark, path, merged)
    return merged


def report_row(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_markdown(spark: SparkSession, path: str, title: str, sections: list[tuple[str, str]]) -> str:
    text = "\n\n".join([f"# {title}", *[f"## {head}\n\n{body}" for head, body in sections]]) + "\n"
    write_text_file(spark, path, text)
    return text


def write_fasta(df: DataFrame, path: str, key: str = "hash", seq: str = "seq") -> None:
    """One record for each key: the least sequence."""
    one = df.groupBy(key).agg(F.min(seq).alias(seq))
    one.select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def new_version(df: DataFrame, base: str) -> str:
    """Write beside the older versions, never over them; the path of the new one."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    number = 1 + max([int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()], default=0)
    path = f"{base}/v{number:05d}"
    seen = Observation()  # counted on the way to the files, so the frame is computed once
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    if spark.read.parquet(path).count() != seen.get["n"]:
        raise ContractError(f"{path} has other rows than were written")
    return path


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with more rows; columns that one side lacks are null."""
    return log.unionByName(rows, allowMissingColumns=True)


def not_yet_done(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output: what a resumed run still has to do."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def patched(samples: DataFrame, assigned: DataFrame, key: str, column: str) -> DataFrame:
    """Every sample with a new column (null where none is assigned); one row in, one row out."""
    if assigned.groupBy(key).count().where("count > 1").limit(1).count():
        raise ContractError(f"{key} is assigned more than once")
    return samples.drop(column).join(assigned.select(key, column), key, "left")
