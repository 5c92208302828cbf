"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of the whole text are column expressions (lengths, shares of letters, capitals, digits
   and signs, repeated words and lines).  Nothing else about a document is an input.
2. On at most `TRAIN_ROWS` labelled rows that are not held out (sampled by hash), small decision trees
   are grown on bootstrap samples, each over some of the statistics.  Every path from a root to a node
   is a rule: a conjunction of comparisons.
3. Logistic weights with an L1 penalty (proximal gradient) are fitted to the rules; the penalty is the
   one with the least loss on a quarter of the training rows.  Most weights become zero.
4. The rules with a weight are compiled into one Spark column expression, which scores all documents.

Defined cases: null counts as empty, and an empty text has a score too.  Without labels every score
is 0.5; with one class only, it is that class's share (smoothed).  Repeated rows are each returned, a
null doc_id too (not held out, never learned from).  Labels without a document, or null ones, are
passed over.  Without documents there are no rows.  Other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlake.llm.common import SPACES, body, held_in

HELD_MOD, HELD_AT = 5, 0
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, LEAST = 60, 3, 16, 15
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)
ITERATIONS = 300
THRESHOLD = 0.3


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and one double column per statistic."""
    text = F.col("__text")
    without = lambda kept: F.length(F.regexp_replace(text, kept, ""))
    rows = docs.select(*keep, body("text").alias("__text")).select(
        *keep, F.length(text).alias("__n"), F.split(text, SPACES, -1).alias("__words"), F.split(text, "\n", -1).alias("__lines"),
        without(r"[^\p{L}]+").alias("__letters"), without(r"[^\p{Lu}]+").alias("__upper"), without("[^0-9]+").alias("__digits"),
        without(r"[^|]+").alias("__bars"), without(r"[^!?]+").alias("__calls"), without(r"[^%#$&*@~^<>{}\[\]=_/\\]+").alias("__signs"), without("[^.,;:]+").alias("__stops"),
    )
    rows = rows.select(
        *keep, "__n", F.size("__words").alias("__w"), F.size(F.array_distinct("__words")).alias("__dw"), F.size("__lines").alias("__l"),
        F.size(F.array_distinct("__lines")).alias("__dl"), F.array_max(F.transform("__words", F.length)).alias("__long"),
        "__letters", "__upper", "__digits", "__bars", "__calls", "__signs", "__stops",
    )
    n, w = F.greatest("__n", F.lit(1)), F.greatest("__w", F.lit(1))
    out = {
        "chars": F.col("__n"), "words": F.col("__w"), "word_length": F.col("__n") / w, "longest": F.col("__long"),
        "letters": F.col("__letters") / n, "upper": F.col("__upper") / n, "digits": F.col("__digits") / n, "bars": F.col("__bars") / n,
        "calls": F.col("__calls") / n, "signs": F.col("__signs") / n, "stops": F.col("__stops") / n,
        "distinct_words": F.col("__dw") / w, "lines": F.col("__l"), "line_length": F.col("__n") / F.greatest("__l", F.lit(1)),
        "distinct_lines": F.col("__dl") / F.greatest("__l", F.lit(1)),
    }
    return rows.select(*keep, *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"s_{k}") for k, c in out.items()))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, statistics and labels of the training rows, in a fixed order."""
    known = labels.where(held_in("doc_id", HELD_MOD, HELD_AT) & F.col("quality").isNotNull()).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    n = known.count()
    few = known.where(F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.95 * TRAIN_ROWS / max(n, 1)))).limit(TRAIN_ROWS)
    # TRAIN_ROWS rows at most, so the broadcast is bounded
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("id")), "doc_id", "label").collect()
    names = [c for c in rows[0].__fields__ if c.startswith("s_")] if rows else []
    rows = sorted(rows, key=lambda r: tuple(r))
    return names, np.array([[r[c] for c in names] for r in rows]), np.array([float(r["label"] == 1) for r in rows])


Rule = tuple  # of (statistic, above, threshold), sorted


def grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], cols: np.ndarray, depth: int, path: Rule, rules: set) -> None:
    """Adds the paths of a tree over the columns `cols` to `rules`."""
    if path:
        rules.add(path)
    if not depth or len(y) < 2 * LEAST or y.min() == y.max():
        return
    best = (1e-9, None, None)
    total, ones = len(y), y.sum()
    impurity = lambda n, k: 2 * k * (n - k) / np.maximum(n, 1)
    for c in cols:
        bins = np.searchsorted(cuts[c], x[:, c], side="left")  # bin b: above the first b cuts
        n = np.cumsum(np.bincount(bins, minlength=len(cuts[c]) + 1))[:-1]
        k = np.cumsum(np.bincount(bins, y, len(cuts[c]) + 1))[:-1]
        gain = impurity(total, ones) - impurity(n, k) - impurity(total - n, ones - k)
        gain[(n < LEAST) | (total - n < LEAST)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), c, cuts[c][int(gain.argmax())])
    _, c, at = best
    if c is None:
        return
    above = x[:, c] > at
    for side in (False, True):
        step = tuple(sorted({*path, (int(c), side, float(at))}))
        grow(x[above == side], y[above == side], cuts, cols, depth - 1, step, rules)


def find_rules(x: np.ndarray, y: np.ndarray, seed: int = 13) -> list[Rule]:
    r = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 1)[1:-1])) for c in range(x.shape[1])]
    rules: set = set()
    for _ in range(TREES):
        rows = r.integers(0, len(y), len(y))
        cols = r.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False)
        grow(x[rows], y[rows], cuts, cols, DEPTH, (), rules)
    return sorted(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, c] > at) == above for c, above, at in rule])


def lasso(z: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of the L1-penalised logistic regression (accelerated proximal gradient)."""
    n, m = z.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    rate = 4.0 / max(1.0, np.linalg.norm(z.astype(np.float32), 2) ** 2 / n + 1)
    for _ in range(ITERATIONS):
        grad = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - rate * (z.T @ grad) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * grad.mean()
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return b, w


def loss(z: np.ndarray, y: np.ndarray, b: float, w: np.ndarray) -> float:
    s = z @ w + b
    return float(np.mean(np.logaddexp(0, s) - y * s))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules."""
    if not len(y):
        return 0.0, []
    if y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return float(np.log(p / (1 - p))), []
    rules = find_rules(x, y)
    z = np.array([holds(rule, x) for rule in rules], dtype=np.float32).T if rules else np.zeros((len(y), 0), dtype=np.float32)
    tested = np.arange(len(y)) % 4 == 3
    losses = [loss(z[tested], y[tested], *lasso(z[~tested], y[~tested], p)) for p in PENALTIES]
    b, w = lasso(z, y, PENALTIES[int(np.argmin(losses))])
    return b, [(rule, float(weight)) for rule, weight in zip(rules, w) if abs(weight) > 1e-4]


def compiled(names: list[str], intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score as one expression over the statistics."""
    total = F.lit(float(intercept))
    for rule, weight in rules:
        test = None
        for c, above, at in rule:
            one = F.col(names[c]) > at if above else F.col(names[c]) <= at
            test = one if test is None else test & one
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of `docs` (doc_id, text), learned from `labels` (doc_id,
    quality)."""
    names, x, y = sample(docs, labels)
    score = compiled(names, *fit(x, y))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_MOD == HELD_AT, F.lit(False))
    rows = statistics(docs, "doc_id").select("doc_id", held.alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
