"""A quality classifier learnt from trusted positives and unlabelled text.

The non-negative unbiased risk of a linear model f is pi*E_P[l(f)] + max(0, E_U[l(-f)] - pi*E_P[l(-f)]): negatives are
never seen, their risk is what the unlabelled texts leave once the positives' share, pi, is taken out, and it is
kept from falling below zero. pi is estimated from the data (the best-bin estimator).

Texts are read once: a task turns each into a few numbers, which are written as a table. Of the positives the driver
takes a sample of bounded size. All that concerns the unlabelled text, means and scales, the part above each threshold, the
risk with its derivatives, is summed over every row by tasks, in a fixed number of passes. Every row is scored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import arrow_column, arrow_map, id_and_text, record_batch, slices
from shelfmark.operators.workspace import written

#: Positives that the driver fits on, at most about this many.
SAMPLE = 20_000
#: Passes over the unlabelled rows for the class prior's scores and for the risk.
PASSES = (8, 14)
#: One in so many rows, by the checksum of its id, is held out.
FOLDS = 5
THRESHOLD = 0.3

_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32),
    "stop": b".,;:?'\"-()", "shout": b"!", "bar": b"|<>{}[]=_/\\~^`", "mark": b"*#$%&@+", "high": range(128, 256),
}
_CLASS = np.full(256, len(_GROUPS), np.uint8)
for _n, _values in enumerate(_GROUPS.values()):
    _CLASS[list(_values)] = _n


def features(text: str) -> list[float]:
    """Shares of kinds of characters and of repeats among words and lines, and lengths; zeros for an empty text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(len(_GROUPS) + 1)
    for at in range(0, len(raw), 1 << 20):
        counts += np.bincount(_CLASS[raw[at : at + (1 << 20)]], minlength=len(counts))
    n = max(1, len(raw))
    words = text.split()
    k = len(words)
    following = words[1:]
    again = sum(map(eq, words, following))
    pairs = len(set(zip(words, following)))
    lines = text.split("\n")
    upper, lower, digit, space, stop, shout, bar, mark, high, other = counts
    return [
        math.sqrt(upper / max(1.0, upper + lower)),
        math.sqrt(digit / n),
        math.sqrt(shout / n),
        math.sqrt(bar / n),
        math.sqrt(mark / n),
        math.sqrt(other / n),
        stop / n,
        high / n,
        space / n,
        math.sqrt(again / max(1, k - 1)),
        math.sqrt(1 - pairs / max(1, k - 1)) if k > 1 else 0.0,
        len(set(words)) / max(1, k) if k < 50 else 1.0,
        1 - len(set(lines)) / len(lines),
        min(20.0, n / max(1, k)) / 10,
        math.log1p(k) / 5,
        1.0 / (1 + k),
    ]


def features_column(text_col: str):
    def run(column: pa.Array) -> pa.Array:
        rows = [np.array(features(t or ""), np.float32) for t in column.to_pylist()]
        return pa.array(rows, pa.list_(pa.float32()))

    return arrow_column(run, "array<float>", F.col(f"`{text_col}`").cast("string"))


@dataclass
class Model:
    """A linear model over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8)
        return _sigmoid(z @ self.weights[:-1] + self.weights[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def standard(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((rows - mean) / scale, -8, 8), np.ones((len(rows), 1))])


#: What tasks sum up of rows: the sum of a function's values over all rows, and how many there are.
Total = Callable[[Callable[[np.ndarray], np.ndarray]], tuple[np.ndarray, int]]


def moments(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows.sum(axis=0), (rows * rows).sum(axis=0)])


def loss_terms(mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Sums of l(-f), its gradient and its second derivatives, flat."""

    def run(rows: np.ndarray) -> np.ndarray:
        x = standard(rows, mean, scale)
        f = x @ w
        s = _sigmoid(f)
        return np.concatenate([[np.logaddexp(0, f).sum()], x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])

    return run


def scores_above(mean: np.ndarray, scale: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """How many rows score at least each of the sorted cuts."""

    def run(rows: np.ndarray) -> np.ndarray:
        return len(rows) - np.searchsorted(np.sort(standard(rows, mean, scale) @ w), cuts, side="left").astype(np.float64)

    return run


def of_array(rows: np.ndarray) -> Total:
    return lambda part: (part(rows), len(rows))


def of_table(rows: DataFrame) -> Total:
    """Totals over the column features of a table, each one pass; only sums of tasks reach the driver."""
    schema = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.float64()))])

    def total(part):
        def run(batches):
            n, sums = 0, 0.0
            for b in slices(batches, 8192):
                if b.num_rows:
                    flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    n, sums = n + b.num_rows, sums + part(flat.reshape(b.num_rows, -1))
            if n:
                yield record_batch(schema, [n], [sums.tolist()])

        parts = sorted((r["n"], *r["sums"]) for r in arrow_map(rows.select("features"), run, "n long, sums array<double>").collect())
        table = np.array(parts)
        return table[:, 1:].sum(axis=0), int(table[:, 0].sum())

    return total


def _newton(terms, size: int, passes: int) -> np.ndarray:
    """Newton steps from zero, so many evaluations of terms(w) -> (value, gradient, second derivatives, allowed). A step that
    does not lower the value, or leaves what is allowed, is halved."""
    w = np.zeros(size)
    value, gradient, second, _ = terms(w)
    step, share = -np.linalg.solve(second, gradient), 1.0
    for _ in range(passes - 1):
        new = w + share * step
        new_value, new_gradient, new_second, allowed = terms(new)
        if allowed and new_value <= value:
            if np.abs(new - w).max() < 1e-9:
                break
            w, value, gradient, second = new, new_value, new_gradient, new_second
            step, share = -np.linalg.solve(second, gradient), 1.0
        else:
            share /= 2
    return w


def class_prior(positive: np.ndarray, above: Callable[[np.ndarray], tuple[np.ndarray, int]]) -> float:
    """Best-bin estimate of the positives' share: over thresholds, the least ratio of the parts of the unlabelled and
    of the positive scores above it, with a bound for the error of either part."""
    p = np.sort(positive)
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.95, 96)))
    over, n = above(cuts)
    slack = math.sqrt(math.log(40) / 2) * (1 / math.sqrt(len(p)) + 1 / math.sqrt(n))
    above_p = 1 - np.searchsorted(p, cuts, side="left") / len(p)
    above_u = over / n
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray | Total, everything: Total | None = None, decay: float = 1e-3) -> Model:
    """Minimises the unbiased risk of the logistic loss where the negatives' part of it is not below zero.

    unlabelled: rows, or totals over them; everything: totals over all rows that means and scales are taken from."""
    if isinstance(unlabelled, np.ndarray):
        everything = of_array(np.concatenate([positive, unlabelled]))
        unlabelled = of_array(unlabelled)
    sums, n = everything(moments)
    mean, squares = np.split(sums / n, 2)
    scale = np.sqrt(np.maximum(0, squares - mean * mean)) + 1e-3
    p = standard(positive, mean, scale)
    size = p.shape[1]

    def unseen(w):
        sums, n = unlabelled(loss_terms(mean, scale, w))
        sums = sums / n
        return sums[0], sums[1 : size + 1], sums[size + 1 :].reshape(size, size)

    def penalised(w, value, gradient, second, allowed):
        return value + decay / 2 * (w @ w), gradient + decay * w, second + decay * np.eye(size), allowed

    def apart(w):  # positives from unlabelled rows, for the class prior alone
        value, gradient, second = unseen(w)
        s = _sigmoid(-p @ w)
        value, gradient = value + np.logaddexp(0, -p @ w).mean(), gradient - p.T @ s / len(p)
        return penalised(w, value, gradient, second + (p * (s * (1 - s))[:, None]).T @ p / len(p), True)

    w = _newton(apart, size, PASSES[0])
    prior = class_prior(p @ w, lambda cuts: unlabelled(scores_above(mean, scale, w, cuts)))

    def risk(w):
        # losses: l(f) = log(1 + exp(-f)); l(f) - l(-f) = -f, so the positives add a linear part
        value, gradient, second = unseen(w)
        f = p @ w
        left = value - prior * np.logaddexp(0, f).mean()
        return penalised(w, value - prior * f.mean(), gradient - prior * p.mean(axis=0), second, left >= 0)

    # sums of tasks may come out differently in their last digits
    return Model(mean, scale, np.round(_newton(risk, size, PASSES[1]), 7), prior)


def held_out(id_col: str = "doc_id"):
    """Whether a row is never learnt from: one fold of the CRC-32 of its id as text; a null id is ''."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def learn(table: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from a table of (id, features) and labels (doc_id, quality); None without any positive.

    An id labelled more than once is positive only if all its labels are 1. Rows without a label are the
    unlabelled text; if there are none, the labelled rows serve as such, their labels unread.
    """
    given = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    rows = table.where(~held_out("id")).join(given.withColumnRenamed("doc_id", "id"), "id", "left")
    kind = F.when(F.col("q") == 1, 0).when(F.col("q").isNull(), 1).otherwise(2)
    rows = rows.select(kind.alias("kind"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)).alias("draw"), "features")
    rows = written(rows, "quality-rows")
    counts = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    if not counts.get(0):
        return None
    kinds = (0, 1) if counts.get(1) else (0, 2)
    reach = int(min(1.0, sample / counts[0]) * (1 << 30))
    drawn = rows.where((F.col("kind") == 0) & (F.col("draw") < reach)).orderBy("draw").select("features").toArrow()
    positive = np.array(drawn.column("features").to_pylist(), np.float64).reshape(drawn.num_rows, -1)
    both = rows.where(F.col("kind").isin(*kinds))
    other = both.where("kind = 1") if kinds[1] == 1 else both
    return fit(positive, of_table(other), of_table(both)) if len(positive) else None


def score_column(model: Model | None):
    def run(column: pa.Array) -> pa.Array:
        if model is None:
            return pa.array([0.5] * len(column), pa.float64())
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.array(model.score(flat.reshape(len(column), -1)), pa.float64())

    return arrow_column(run, "double", "features")


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on) of every row.

    A null text is scored as an empty one, a row with a null id too; without any positive label all score 0.5.
    """
    table = id_and_text(docs, id_col, text_col).select("id", features_column("text").alias("features"))
    table = written(table, "quality-features")
    model = learn(table, labels, sample)
    scored = table.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns; nothing is shuffled but numbers."""
    table = id_and_text(docs, id_col, text_col).select("id", features_column("text").alias("features"))
    model = learn(written(table, "quality-features"), labels, sample)
    if model is None:
        return docs

    def good(column: pa.Array) -> pa.Array:
        rows = np.array([features(t or "") for t in column.to_pylist()], np.float32).astype(np.float64)
        return pa.array(model.score(rows.reshape(len(column), -1)) >= THRESHOLD, pa.bool_())

    return docs.where(arrow_column(good, "boolean", F.col(f"`{text_col}`").cast("string")))


def fold_of(doc_id: int) -> int:
    """What held_out computes, in Python."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
