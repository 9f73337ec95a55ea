"""Quality classification by importance resampling.

Hashed n-gram models of two corpora, target text (labelled good and not toxic) and raw text
(all documents), give each document a log importance weight: the sum of log p_target/p_raw
over its n-grams, divided by the root of their number. N-grams are tokens, token pairs and
the first 5 to 8 bytes of longer tokens. A bucket counts where the two models differ by
``Z`` standard deviations or more; the others are noise and add nothing. A document of the
target is weighed as if it were not in the models.

Documents are then drawn without replacement by Gumbel top-k: the k largest values of
``sharpness`` x weight + Gumbel noise, so documents near the cut are drawn by chance. k is the number of documents whose weight reaches the
threshold that best parts the labelled good from the labelled bad, so k follows the corpus.
The k-th value is found exactly by counting in ever finer bins.

Bounds: the models of target text and the threshold are fitted on at most ``LABELLED``
labelled rows, chosen by a hash of the id; counts of raw text cover every document.

Defined results: a null or empty text has no n-grams and weight 0; equal values at the cut
are all kept; repeated rows are weighed alike; a null id has no label and draws its noise from
a hash of null; an empty table stays empty; other columns pass. Where no document is labelled
good, or none bad, there is nothing to part: every document is kept, with weight 0 where there
is no model, or with ``one_kind="error"`` that is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerlens.llm import kernels as K

BITS = 18
PARTS = 64
PREFIXES = (5, 6, 7, 8)
PSEUDO, Z = 0.5, 5.0
#: of the weights against the noise of the draw; 1 / temperature
SHARPNESS = 10.0
LABELLED = 50_000
BINS = 4096


def features(column: pa.Array):
    """Slices of texts: the first row, bucket numbers in text order, and each text's bounds."""
    shift = np.uint64(64 - BITS)
    for w in K.words(column, tokens=True):
        hashes, texts = [K.mix(w.hash)], [w.text]
        two = w.text[1:] == w.text[:-1]
        hashes.append(K.fold(w.hash, 2)[two])
        texts.append(w.text[1:][two])
        length, value, at = w.stop - w.start, np.zeros(len(w.hash), np.uint64), w.start
        last = max(len(w.data) - 1, 0)
        for k in range(max(PREFIXES)):
            value = value * np.uint64(257) + w.data[np.minimum(at + k, last)] if len(value) else value
            if k + 1 in PREFIXES:
                long = length > k + 1
                hashes.append(K.mix(value[long] * np.uint64(31) + np.uint64(k + 1)))
                texts.append(w.text[long])
        text = np.concatenate(texts)
        order = np.argsort(text, kind="stable")
        buckets = (np.concatenate(hashes)[order] >> shift).astype(np.int64)
        yield w.first, buckets, np.searchsorted(text[order], np.arange(w.count + 1))


def _count(good: np.ndarray):
    """One row of counts for each part of the buckets: raw and target text of this task."""

    def run(batches):
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        docs = 0
        for b in batches:
            docs += b.num_rows
            mine = np.isin(b.column(0).to_numpy(zero_copy_only=False), good)
            for first, buckets, bounds in features(b.column(1)):
                raw += np.bincount(buckets, minlength=1 << BITS)
                own = np.repeat(mine[first : first + len(bounds) - 1], np.diff(bounds))
                if own.any():
                    target += np.bincount(buckets[own], minlength=1 << BITS)
        if docs:
            rows = [(r.tobytes(), t.tobytes()) for r, t in zip(np.split(raw, PARTS), np.split(target, PARTS))]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "raw", "target"])

    return run


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    total = [sum(np.frombuffer(x, np.int64) for x in frame[c]).tobytes() for c in ("raw", "target")]
    return pd.DataFrame({"part": [frame["part"].iloc[0]], "raw": [total[0]], "target": [total[1]]})


def fit(docs: DataFrame, good: np.ndarray, key: str = "doc_id", text: str = "text") -> dict:
    """Counts of the two models; ``good`` has the ids of target text, of bounded number."""
    each = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(_count(good), "part int, raw binary, target binary")
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    size = (1 << BITS) // PARTS
    for r in each.groupBy("part").applyInPandas(_add, "part int, raw binary, target binary").collect():  # PARTS rows
        raw[r[0] * size : (r[0] + 1) * size] = np.frombuffer(r[1], np.int64)
        target[r[0] * size : (r[0] + 1) * size] = np.frombuffer(r[2], np.int64)
    return {"raw": raw, "target": target, "good": good}


def _ratio(raw: np.ndarray, target: np.ndarray, raw_all: float, target_all: float) -> np.ndarray:
    expected = raw * (target_all / max(raw_all, 1.0))
    far = np.abs(target - expected) >= Z * np.sqrt(expected + 1)
    return np.where(far, np.log((target + PSEUDO) / (expected + PSEUDO)), 0.0)


def weigh(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``log_weight`` to every row, keeping all columns."""
    own = [c for c in df.columns if c != "log_weight"]
    shared = df.sparkSession.sparkContext.broadcast(model)  # 4 MB and at most LABELLED ids
    at_key, at_text = own.index(key), own.index(text)

    def run(batches):
        raw, target, good = shared.value["raw"], shared.value["target"], shared.value["good"]
        raw_all, target_all = float(raw.sum()), float(target.sum())
        table = _ratio(raw, target, raw_all, target_all)
        for b in batches:
            out = np.zeros(b.num_rows)
            mine = np.isin(b.column(at_key).cast(pa.int64()).to_numpy(zero_copy_only=False), good)
            for first, buckets, bounds in features(b.column(at_text)):
                sums = np.concatenate([[0.0], np.cumsum(table[buckets])])
                part = sums[bounds[1:]] - sums[bounds[:-1]]
                for i in np.flatnonzero(mine[first : first + len(part)]):
                    f = buckets[bounds[i] : bounds[i + 1]]
                    u, c = np.unique(f, return_counts=True)
                    part[i] = (c * _ratio(raw[u] - c, target[u] - c, raw_all - len(f), target_all - len(f))).sum()
                out[first : first + len(part)] = np.round(part / np.sqrt(np.maximum(np.diff(bounds), 1)), 9)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*own, "log_weight"])

    given = df.select(*[F.col(f"`{c}`") for c in own])
    return given.mapInArrow(run, StructType([*given.schema.fields, StructField("log_weight", DoubleType())]))


def gumbel(key: Column, seed: int = 29) -> Column:
    """Gumbel noise from a hash of the id."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return -F.log(-F.log(u))


def _best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight that best parts the labelled; midway in the gap where it falls."""
    values = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(np.sort(good), values, "left") / len(good)
    passed = 1 - np.searchsorted(np.sort(bad), values, "left") / len(bad)
    i = int(np.argmax(kept - passed))
    return float(values[i]) if i == 0 else float((values[i] + values[i - 1]) / 2)


def kth_largest(scores: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly, from counts in ever finer bins."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    left, known = k, scores
    for _ in range(20):
        if low is None or low >= high:
            return low if low is not None else 0.0
        width = (high - low) / BINS
        if width <= 0 or low + width <= low:
            return low
        number = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        found = sorted(known.groupBy(number.alias("bin")).agg(F.count("*"), F.min(column), F.max(column)).collect(), reverse=True)  # at most BINS rows
        for _, n, least, most in found:
            if left <= n:
                low, high = least, most
                break
            left -= n
        if left == n:
            return low
        known = scores.where(F.col(column).between(low, high))
    return low


def labelled_ids(labels: DataFrame, key: str = "doc_id", bound: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of good and of bad rows among at most ``bound`` labelled ones."""
    some = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).orderBy(F.xxhash64(key), key).limit(bound)
    rows = some.select(F.col(key).cast("long"), ((F.coalesce(F.col("quality"), F.lit(1)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("ok")).where(F.col(key).isNotNull()).collect()
    return np.array(sorted({r[0] for r in rows if r[1]}), np.int64), np.array(sorted({r[0] for r in rows if not r[1]}), np.int64)


def _only(one_kind: str, what: str) -> None:
    if one_kind != "keep":
        raise ValueError(f"{what} are not both good and bad, so none can be rejected")


def resample(docs: DataFrame, labels: DataFrame, scratch, key: str = "doc_id", text: str = "text", sharpness: float = SHARPNESS, one_kind: str = "keep") -> DataFrame:
    """The drawn rows with all their columns, ``log_weight`` and ``gumbel_key``.

    ``scratch`` writes the weights once; texts are never written or shuffled. ``one_kind``
    (keep or error) says what happens where labels are of one kind.
    """
    good, bad = labelled_ids(labels, key)
    if not len(good) or not len(bad):
        _only(one_kind, "the labels")
        return docs.withColumn("log_weight", F.lit(0.0)).withColumn("gumbel_key", gumbel(F.col(key)))
    model = fit(docs, good, key, text)
    score = F.lit(sharpness) * F.col("log_weight") + gumbel(F.col(key))
    pairs = weigh(docs.select(key, text), model, key, text).select(F.col(key).cast("long").alias("id"), "log_weight", score.alias("gumbel_key"))
    weights = scratch.write(pairs, "weights")
    spark = docs.sparkSession
    known = spark.createDataFrame(pd.DataFrame({"id": np.concatenate([good, bad]), "ok": np.concatenate([np.ones(len(good), bool), np.zeros(len(bad), bool)])}))
    found = weights.join(F.broadcast(known), "id").groupBy("id", "ok").agg(F.min("log_weight").alias("log_weight")).toPandas()  # at most LABELLED rows
    out = weigh(docs, model, key, text).withColumn("gumbel_key", score)
    ok = found["ok"].to_numpy(bool)
    if not ok.any() or ok.all():
        scratch.drop("weights")
        if len(ok) or not docs.isEmpty():
            _only(one_kind, "the labelled documents")
        return out
    threshold = _best_threshold(found["log_weight"].to_numpy()[ok], found["log_weight"].to_numpy()[~ok])
    k = weights.where(F.col("log_weight") >= threshold).count()
    cut = kth_largest(weights, "gumbel_key", k) if k else float("inf")
    scratch.drop("weights")
    return out.where(F.col("gumbel_key") >= cut)
