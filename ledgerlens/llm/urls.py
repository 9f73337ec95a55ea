"""URL filters by a sort-merge range join.

A host is keyed by its labels in reverse (``a.example.com`` is ``com.example.a.``), so a
rule for a host and its subdomains is an interval of keys. Rules and urls are dealt to the
same key ranges; a rule goes to each range that its interval meets. Each range is sorted by
key and swept once: a stack holds the rules whose interval is open, nested ones on top.
Ranges are cut on (key, salt), so a host with a third of all rows is spread over many.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule;
a url that no rule fits gets ``default``; of equal rules, ``block`` comes before ``allow``;
repeated urls are judged alike; other columns pass unchanged, except that ``host``,
``path``, ``rule`` and ``verdict`` are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: sampled rows for each range, to place the cuts; they change the balance, never results
SAMPLED_PER_RANGE = 40
LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z lowered."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _cuts(keyed: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Ascending (key, salt) cuts from a sample of bounded size."""
    rows = keyed.count()
    share = min(1.0, SAMPLED_PER_RANGE * ranges / max(rows, 1))
    found = sorted((r[0], r[1]) for r in keyed.select("_key", "_salt").sample(share, seed=11).limit(4 * SAMPLED_PER_RANGE * ranges).collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if len(found) >= ranges else []


def _deal(columns: list[str], at: int, salt: int, cuts: list[tuple[str, int]]):
    """Put the number of its range beside each row."""

    def run(batches):
        for b in batches:
            keys, salts = b.column(at).to_pylist(), b.column(salt).to_pylist()
            ids = [bisect_right(cuts, (k, s)) for k, s in zip(keys, salts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int32())], names=[*columns, "_range"])

    return run


def _sweep(columns: list[str], default: str):
    """Walk sorted rules and urls with a stack of open rules."""

    def run(batches):
        stack: list[tuple[str, dict[str, tuple[str, str, int]], list[int]]] = []
        for b in batches:
            keys, kinds = b.column("_key").to_pylist(), b.column("_kind").to_pylist()
            paths, rules, verdicts = b.column("path").to_pylist(), b.column("rule").to_pylist(), b.column("verdict").to_pylist()
            keep, out_rule, out_verdict = [], [], []
            for i, key in enumerate(keys):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kinds[i] == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, by_path, lengths = stack[-1]
                    old = by_path.get(paths[i])
                    if old is None or verdicts[i] == "block":
                        by_path[paths[i]] = (rules[i], verdicts[i], len(rules[i]))
                        lengths[:] = sorted({len(p) for p in by_path}, reverse=True)
                    continue
                best, path = None, paths[i]
                for _, by_path, lengths in reversed(stack):
                    for n in lengths:
                        if (hit := by_path.get(path[:n])) and n <= len(path):
                            if best is None or hit[2] > best[2]:
                                best = hit
                            break
                keep.append(i)
                out_rule.append(best[0] if best else None)
                out_verdict.append(best[1] if best else default)
            if keep:
                rows = b.take(pa.array(keep))
                made = {"rule": pa.array(out_rule, pa.string()), "verdict": pa.array(out_verdict, pa.string())}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else rows.column(c) for c in columns], names=columns)

    return run


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to each row of ``df``.

    ``rules`` has string columns host, path and verdict; it may be of any size. A rule fits
    its host and all subdomains where the path starts with the rule's; the longest wins.
    """
    spark = df.sparkSession
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    address = F.col(f"`{url}`").cast("string")
    keyed = df.select(*[F.col(f"`{c}`") for c in own], host_of(address).alias("host"), path_of(address).alias("path"))
    none = F.lit(None).cast("string")
    keyed = keyed.select("*", none.alias("rule"), none.alias("verdict"), host_key(F.col("host")).alias("_key"), F.lit(1).alias("_kind"))
    keyed = keyed.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    cuts = _cuts(keyed, ranges)
    out = [*own, "host", "path", "rule", "verdict"]
    names = keyed.columns
    dealt_schema = StructType([*keyed.schema.fields]).add("_range", IntegerType())
    urls = keyed.mapInArrow(_deal(names, names.index("_key"), names.index("_salt"), cuts), dealt_schema)

    marks = rules.select(F.col("host").alias("host"), F.col("path").alias("path"), F.concat("host", "path").alias("rule"), F.lower("verdict").alias("verdict"), host_key(F.col("host")).alias("_key"), F.lit(0).alias("_kind"))
    low, high = _range_of(cuts, "_key", ""), _range_of(cuts, "_key", LAST)
    marks = marks.withColumn("_range", F.explode(F.sequence(low, high)))
    marks = marks.select(*[F.lit(None).cast(keyed.schema[c].dataType).alias(c) if c in own else F.col(c) for c in [*out, "_key", "_kind"]], F.lit(0).cast("long").alias("_salt"), "_range")
    events = urls.unionByName(marks).repartitionById(len(cuts) + 1, F.col("_range")).sortWithinPartitions("_key", "_kind", "path")
    schema = StructType([StructField(f.name, f.dataType, True) for f in keyed.select(*out).schema.fields])
    assert isinstance(schema["rule"].dataType, StringType)
    return events.mapInArrow(_sweep(out, default), schema)


def _range_of(cuts: list[tuple[str, int]], key: str, end: str) -> Column:
    """The range in which the interval of a rule's key begins or ends, by a search over cuts."""
    if not cuts:
        return F.lit(0)

    def search(batch_keys: pd.Series) -> pd.Series:
        at = [bisect_right(cuts, (k + end, -(2**63))) for k in batch_keys]
        return pd.Series(at, dtype="int32")

    return F.pandas_udf(search, "int")(F.col(key))
