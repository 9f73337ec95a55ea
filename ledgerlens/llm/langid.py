"""Language identification by a byte convolutional network trained in numpy.

Filters of widths 2, 3 and 4 run over the bytes of fixed-length windows; each filter's
largest response in a window (max pooling) feeds a softmax over languages. A text is cut
into windows that cover all of it; its log probabilities are summed over windows, weighted
by their bytes. Inference adds table rows for byte pairs, which is the same convolution.

Defined results: null text, empty text or text without a letter gets ``und`` with score 0;
very long texts are windowed whole; equal texts get equal results; without labelled rows
every text is ``und``; other columns pass, except that ``lang_pred`` and ``score`` are
replaced.

Training reads about 1.2 x ``per_language`` texts of each language (those of a hash of the id
below a share), 2 x ``per_language`` x languages in all at most,
and ``windows`` windows of each text, spread over all of it; these are documented bounds of
the fit alone. Every text is predicted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

WIDTHS = (2, 3, 4)
WINDOW = 256
FILTERS = 16
#: bounds of the fit
PER_LANGUAGE, WINDOWS_A_TEXT = 1200, 6
#: windows worked on at once
BLOCK = 64


class ByteNet:
    """Tables[w][j] is the response of the filters of width w to byte b at place j."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3 / w, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in self.tables:
            t[:, 0, :] = 0  # the byte of padding
        pooled = FILTERS * len(WIDTHS)
        self.bias = np.zeros(pooled, np.float32)
        self.out = rng.normal(0, 0.1, (pooled, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest responses in each window, and where they are."""
        tops, places = [], []
        for w, t in zip(WIDTHS, self.tables):
            last = WINDOW - w + 1
            resp = t[0][x[:, :last]]
            for j in range(1, w):
                resp += t[j][x[:, j : last + j]]
            at = resp.argmax(1)
            tops.append(np.take_along_axis(resp, at[:, None, :], 1)[:, 0, :])
            places.append(at)
        return np.concatenate(tops, 1), places

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, seed: int = 3) -> None:
        """Adam on the cross entropy; the gradient of a maximum goes to its place alone."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                xb, yb, wb = x[rows], y[rows], weight[rows]
                top, places = self.pooled(xb)
                pre = top + self.bias
                act = np.maximum(pre, 0)
                z = act @ self.out + self.out_bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p *= (wb / wb.sum())[:, None]
                back = (p @ self.out.T) * (pre > 0)
                grads = []
                for k, (w, t) in enumerate(zip(WIDTHS, self.tables)):
                    g, part, at = np.zeros_like(t), back[:, k * FILTERS : (k + 1) * FILTERS], places[k]
                    cols = np.broadcast_to(np.arange(FILTERS), at.shape)
                    for j in range(w):
                        byte = np.take_along_axis(xb, at + j, 1)
                        np.add.at(g[j], (byte, cols), part)
                        g[j][0] = 0
                    grads.append(g)
                grads += [back.sum(0), act.T @ p, p.sum(0)]
                step += 1
                for i, (q, g) in enumerate(zip(params, grads)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    q -= 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def packed(self) -> dict:
        """Fixed-point tables by byte pairs, for fast inference."""
        scale = 4000.0 / max(1e-6, *(float(np.abs(t).max()) for t in self.tables))
        q = [np.rint(t * scale).astype(np.int16) for t in self.tables]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return {
            "languages": self.languages, "scale": scale, "bias": self.bias, "out": self.out, "out_bias": self.out_bias,
            "p2": pair(q[0][0], q[0][1]), "p3": pair(q[1][0], q[1][1]), "s3": q[1][2].copy(), "p4a": pair(q[2][0], q[2][1]), "p4b": pair(q[2][2], q[2][3]),
        }


def log_probabilities(net: dict, x: np.ndarray) -> np.ndarray:
    """For windows of bytes, the log probability of each language."""
    parts = []
    for i in range(0, len(x), BLOCK):
        b = x[i : i + BLOCK]
        pairs = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
        two = net["p2"].take(pairs, 0).max(1)
        three = net["p3"].take(pairs[:, : WINDOW - 2], 0)
        three += net["s3"].take(b[:, 2:], 0)
        four = net["p4a"].take(pairs[:, : WINDOW - 3], 0)
        four += net["p4b"].take(pairs[:, 2:], 0)
        parts.append(np.concatenate([two, three.max(1), four.max(1)], 1))
    z = np.maximum(np.concatenate(parts) / np.float32(net["scale"]) + net["bias"], 0) @ net["out"] + net["out_bias"]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows_of(text: bytes) -> np.ndarray:
    """The whole text in rows of WINDOW bytes, the last padded with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def _predict_batch(net: dict, texts: pa.Array, letters: np.ndarray) -> tuple[list[str], list[float]]:
    """Predictions of a batch, some windows at a time."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    held: list[tuple[int, np.ndarray, int]] = []
    count = 0

    def flush() -> None:
        if not held:
            return
        starts = np.cumsum([0, *(len(w) for _, w, _ in held[:-1])])
        logp = log_probabilities(net, np.concatenate([w for _, w, _ in held]))
        weight = np.full(len(logp), WINDOW, np.float32)
        weight[[s + len(w) - 1 for s, (_, w, _) in zip(starts, held)]] = [max(1, n - (len(w) - 1) * WINDOW) for _, w, n in held]
        total = np.add.reduceat(logp * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
        total = np.exp(total - total.max(1, keepdims=True))
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        for (i, _, _), k, row in zip(held, best, total):
            names[i], scores[i] = net["languages"][k], float(row[k])
        held.clear()

    for i in np.flatnonzero(letters):
        text = texts[int(i)].as_py().encode()
        held.append((int(i), w := windows_of(text), len(text)))
        count += len(w)
        if count >= 2048:
            flush()
            count = 0
    flush()
    return names, scores


def fraction_hash(column: Column, salt: int) -> Column:
    """An even number in [0, 1) from a column, the same on every run."""
    return F.pmod(F.xxhash64(column.cast("string"), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, epochs: int = 12) -> dict | None:
    """Fit on rows of known language; the bounds are those of the module's docstring."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(lang) == name, F.lit(1.2 * per_language / n)).otherwise(share)
    part = lambda i: F.substring(F.col(text), (F.length(text) * i / WINDOWS_A_TEXT).cast("int") + 1, F.lit(WINDOW))
    chosen = rows.where(fraction_hash(F.col(key), 5) < share).select(lang, F.array(*[part(i) for i in range(WINDOWS_A_TEXT)]).alias("parts"))
    found = chosen.limit(2 * per_language * len(counts)).collect()
    languages = sorted(counts)
    rng, xs, ys, done = np.random.default_rng(1), [], [], set()
    for name, parts in sorted((r[0], list(r[1])) for r in found):
        for p in dict.fromkeys(parts):
            raw = p.encode()[:WINDOW]
            if (name, raw) in done or not any(c.isalpha() for c in p):
                continue
            done.add((name, raw))
            cut = raw
            if rng.random() < 0.35 and len(raw) > 12:  # short texts occur too
                n = int(rng.integers(8, len(raw)))
                at = int(rng.integers(0, len(raw) - n + 1))
                cut = raw[at : at + n]
            xs.append(windows_of(cut)[0])
            ys.append(languages.index(name))
    x, y = np.stack(xs), np.array(ys)
    per = np.bincount(y, minlength=len(languages))
    net = ByteNet(languages)
    net.fit(x, y, (1.0 / np.maximum(per, 1))[y].astype(np.float32), epochs)
    return net.packed()


def predict(df: DataFrame, net: dict | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to each row."""
    own = [c for c in df.columns if c not in ("lang_pred", "score")]
    if net is None:
        return df.select(*[F.col(f"`{c}`") for c in own], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    letters = "_letters" + "_" * max(map(len, own))  # no column's name
    given = df.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias(letters))
    shared = df.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the input
    at = own.index(text)

    def run(batches):
        net = shared.value
        for b in batches:
            names, scores = _predict_batch(net, b.column(at), b.column(len(own)).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*own, "lang_pred", "score"])

    schema = StructType([*given.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return given.mapInArrow(run, schema)
