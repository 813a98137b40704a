"""Quality classifier: a generalised additive model with pairwise interactions.

Features come from the whole text alone. Each is cut into quantile bins. Cyclic
boosting visits the features in turn and adds a shallow tree (a best split into
up to ``LEAVES`` runs of bins) on the logistic gradient to that feature's lookup
table, step by step; then the pairs of features whose residual grid gains most
are boosted the same way on a coarser grid. A text's score is the logistic of
one addition per table, done for whole batches at once.

The model is fitted on a bounded sample of labelled rows, the ``SAMPLE`` with
the smallest hashes of their ids in the training folds; everything else reads
all rows. Rows outside the training folds are never learnt from.

Nulls: a null text scores as an empty one; labels with a null id or null quality
are left out; an id labelled several times counts as often; without labels all
scores are 0.5. Repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, hashed_sample, lean, small_batches, table

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
BINS, GRID, LEAVES, PAIRS = 64, 12, 4, 12
MAIN_ROUNDS, PAIR_ROUNDS, RATE = 60, 30, 0.1

FEATURES = (
    "log_words", "log_chars", "mean_word", "long_words", "distinct_words", "top_word", "repeated_lines", "line_words",
    "upper", "digits", "symbols", "punctuation", "pipes", "exclaims", "stops", "non_ascii", "capital_words", "symbol_words", "short_words", "repeated_trigrams",
)

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&<>@^~\\{}[]_=+"
_PUNCTUATION = b",;:'\"()-?!./"


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def text_features(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    size = len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    codes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64) if n > 2 else None
    if codes is not None:
        mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[2:]
        repeated = 1 - len(np.unique(mixed)) / len(mixed)
    else:
        repeated = 0.0
    first = b"".join([w[:1] for w in words])
    last = b"".join([w[-1:] for w in words])
    high = size - len(text.translate(None, bytes(range(128, 256))))
    return (
        np.log1p(n), np.log1p(size), size / n, float((lengths > 15).sum()) / n, len(seen) / n, max(seen.values()) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        _count(text, _UPPER) / size, _count(text, _DIGITS) / size, _count(text, _SYMBOLS) / size, _count(text, _PUNCTUATION) / size, text.count(b"|") / n, text.count(b"!") / n, text.count(b".") / n,
        high / size, _count(first, _UPPER) / n, _count(last, _SYMBOLS) / n, float((lengths < 4).sum()) / n, repeated,
    )


def feature_matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([text_features(t or b"") for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cut, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cut, x[:, j], side="right")]
        for a, b, values in self.pairs:
            total += values[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES, ridge: float = 1.0) -> np.ndarray:
    """Leaf values by bin: greedy splits of the bins' runs on gain."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    runs = [(0, len(g))]

    def best(a: int, b: int):
        if b - a < 2:
            return -1.0, 0
        at = np.arange(a + 1, b)
        gl, hl, gr, hr = G[at] - G[a], H[at] - H[a], G[b] - G[at], H[b] - H[at]
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
        k = int(gain.argmax())
        return float(gain[k]), int(at[k])

    while len(runs) < leaves:
        gain, at, r = max((*best(*r), r) for r in runs)
        if gain <= 1e-9:
            break
        runs.remove(r)
        runs += [(r[0], at), (at, r[1])]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    model = Model()
    if not len(y) or y.min() == y.max():
        model.base = 0.0 if not len(y) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return model
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    model.cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.coarse = [_cuts(x[:, j], GRID) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    grid = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    f = np.full(len(y), model.base)

    def gradient():
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(MAIN_ROUNDS):
        for j, b in enumerate(bins):
            r, h = gradient()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(b, r, n), np.bincount(b, h, n))
            model.tables[j] += step
            f += step[b]
    r, h = gradient()
    gains = []
    for a in range(x.shape[1]):
        for b in range(a):
            n, m = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
            cell = grid[a] * m + grid[b]
            gains.append((float((np.bincount(cell, r, n * m) ** 2 / (np.bincount(cell, h, n * m) + 5.0)).sum()), a, b))
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    tables = {p: np.zeros((len(model.coarse[p[0]]) + 1, len(model.coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            r, h = gradient()
            n, m = tables[a, b].shape
            cell = grid[a] * m + grid[b]
            g2, h2 = np.bincount(cell, r, n * m).reshape(n, m), np.bincount(cell, h, n * m).reshape(n, m)
            # a two-level tree: the better of the two first splits, then each side over the other feature
            sides = []
            for axis in (0, 1):
                first = _tree(g2.sum(1 - axis), h2.sum(1 - axis), 2)
                low = first == first[0]
                step = np.zeros((n, m))
                for part in (low, ~low):
                    if part.any():
                        sub_g, sub_h = (g2[part].sum(0), h2[part].sum(0)) if axis == 0 else (g2[:, part].sum(1), h2[:, part].sum(1))
                        leaf = _tree(sub_g, sub_h, 2)
                        if axis == 0:
                            step[part] = leaf
                        else:
                            step[:, part] = leaf[:, None]
                sides.append((float((g2 * step).sum() - 0.5 * (h2 * step**2).sum()), axis, step))
            step = RATE * max(sides, key=lambda s: s[:2])[2]
            tables[a, b] += step
            f += step[grid[a], grid[b]]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


def _texts(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def _features_of(batches):
    for batch in batches:
        x = feature_matrix(_texts(batch.column(0)))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, sample: int = SAMPLE) -> Model:
    """The model, learnt from at most ``sample`` labelled rows outside the held-out fold."""
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y")).where(F.col("__id").isNotNull() & F.col("y").isNotNull() & (fold_of("__id", folds) != held))
    small_batches(docs.sparkSession)
    chosen = hashed_sample(marked.distinct(), F.xxhash64(F.col("__id")), ["__id", "y"], sample)
    given = docs.select(F.col(id_col).alias("__of"), F.col(text_col).alias("text"))
    rows = given.join(F.broadcast(chosen), F.col("__of") == F.col("__id")).select("__id", "text", "y")
    rows = rows.groupBy("__id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y")  # an id that repeats counts once
    got = rows.mapInArrow(lean(_features_of), "y double, x array<double>").toPandas()
    if not len(got):
        return Model()
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # rows come in any order; sums must not depend on it
    return fit(x[order], y[order])


def _scored(model: Model, at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            s = model.score(feature_matrix(_texts(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return lean(run)


def with_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted; columns of these names are replaced."""
    kept = docs.drop(*[c for c in ("score", "predicted") if c != text_col])
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return kept.mapInArrow(_scored(model, kept.columns.index(text_col), kept.columns), schema)


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs.withColumn("held_out", fold_of("doc_id", 3) == 1), model).select("doc_id", "held_out", "score", "predicted")
