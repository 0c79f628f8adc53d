"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import crc_mod, map_rows

#: Labelled rows that the model is fitted on: those with the smallest keyed hash.
SAMPLE_ROWS = 20_000
#: Bins for each feature, boosting cycles, learning rate, leaves of a tree, pairs of features, least rows and shrinkage in a leaf.
BINS, CYCLES, RATE, LEAVES, PAIRS, PAIR_BINS, LEAF_ROWS, SHRINK = 64, 120, 0.1, 4, 6, 8, 10, 5.0
#: A document is kept from this score on.
CUTOFF = 0.3

FEATURES = (
    "log_words", "chars_per_word", "symbols_per_word", "bars_per_word", "bangs_per_word", "upper_share", "digit_share",
    "punctuation_share", "repeated_pairs", "repeated_windows", "distinct_share", "duplicate_lines", "words_per_line", "high_share",
)


def text_features(text: str | None) -> list[float]:
    """The features of a whole text; all of them 0 for null, empty or blank text."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    of = lambda chars: int(count[list(chars)].sum())
    upper, lower, high = int(count[65:91].sum()), int(count[97:123].sum()), int(count[128:].sum())
    total = int(count.sum())
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    windows = max(1, n - 2)
    return [
        float(np.log1p(n)), (total - of(b" \t\n\x0b\f\r")) / n, of(b"#*$%&<>") / n, of(b"|") / n, of(b"!") / n,
        upper / max(1, upper + lower), int(count[48:58].sum()) / total, of(b".,;:?'\"()-") / total,
        sum(map(eq, words, words[1:])) / n, 1 - len(set(zip(words, words[1:], words[2:]))) / windows if n > 2 else 0.0,
        len(set(words)) / n, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), high / total,
    ]


class AdditiveModel:
    """Lookup tables for single features and pairs; the log odds are the sum of the entries a row falls in."""

    def __init__(self, edges, tables, pairs, pair_tables, base: float):
        self.edges, self.tables, self.pairs, self.pair_tables, self.base = edges, tables, pairs, pair_tables, base

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for table, b in zip(self.tables, bins):
            total += table[b]
        for (i, j, ci, cj), table in zip(self.pairs, self.pair_tables):
            total += table[ci[bins[i]], cj[bins[j]]]
        return 1 / (1 + np.exp(-total))


def _tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int) -> np.ndarray:
    """A piecewise constant update along one ordered axis of bins: the best splits, greedily, one leaf at a time."""
    g, h, n = (np.concatenate([[0.0], np.cumsum(v)]) for v in (gradient, weight, rows))

    def best(lo: int, hi: int):
        cut = np.arange(lo + 1, hi)
        if not len(cut):
            return 0.0, 0
        value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + SHRINK)
        gain = value(lo, cut) + value(cut, hi) - value(lo, hi)
        gain[(n[cut] - n[lo] < LEAF_ROWS) | (n[hi] - n[cut] < LEAF_ROWS)] = 0
        at = int(np.argmax(gain))
        return float(gain[at]), int(cut[at])

    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        gain, at, k = max((*best(lo, hi), k) for k, (lo, hi) in enumerate(parts))
        if gain <= 1e-9:
            break
        lo, hi = parts.pop(k)
        parts += [(lo, at), (at, hi)]
    update = np.zeros(len(gradient))
    for lo, hi in parts:
        update[lo:hi] = (g[hi] - g[lo]) / (h[hi] - h[lo] + SHRINK)
    return update


def _grid(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A depth-2 update on a pair's grid: the best cut of one axis, then of the other axis on each side."""
    best_gain, best = 0.0, np.zeros_like(gradient)
    for axis in (0, 1):
        g, h, n = (v if axis == 0 else v.T for v in (gradient, weight, rows))
        for cut in range(1, g.shape[0]):
            update, gain = np.zeros_like(g), 0.0
            for side in (slice(0, cut), slice(cut, g.shape[0])):
                line = _tree(g[side].sum(0), h[side].sum(0), n[side].sum(0), 2)
                update[side] = line
                gain += float((line * g[side].sum(0)).sum())
            if gain > best_gain:
                best_gain, best = gain, update if axis == 0 else update.T
    return best


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting: one shallow tree for each feature in turn, then for the pairs that explain most of the rest.

    Without rows of both labels the model is the smoothed share of label 1 for every input.
    """
    n, m = len(x), len(FEATURES)
    share = (float(y.sum()) + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.array([]) for j in range(m)]
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], [], [], base)
    if not n or y.min() == y.max():
        return model
    bins = model.bins(x)
    rows = [np.bincount(b, minlength=len(t)).astype(float) for b, t in zip(bins, model.tables)]
    total = np.full(n, base)
    for _ in range(CYCLES):
        for j in range(m):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[j])
            update = RATE * _tree(np.bincount(bins[j], y - p, size), np.bincount(bins[j], p * (1 - p), size), rows[j], LEAVES)
            model.tables[j] += update
            total += update[bins[j]]
    coarse = [(np.arange(len(t)) * PAIR_BINS // max(1, len(t))).astype(int) for t in model.tables]
    cells = lambda i, j: coarse[i][bins[i]] * PAIR_BINS + coarse[j][bins[j]]
    grid = lambda v: v.reshape(PAIR_BINS, PAIR_BINS)
    p = 1 / (1 + np.exp(-total))
    strength = []
    for i in range(m):
        for j in range(i + 1, m):
            g = np.bincount(cells(i, j), y - p, PAIR_BINS**2)
            h = np.bincount(cells(i, j), p * (1 - p), PAIR_BINS**2)
            strength.append((float((g**2 / (h + SHRINK)).sum()), i, j))
    for _, i, j in sorted(strength, reverse=True)[:PAIRS]:
        model.pairs.append((i, j, coarse[i], coarse[j]))
        model.pair_tables.append(np.zeros((PAIR_BINS, PAIR_BINS)))
    for _ in range(CYCLES // 4):
        for k, (i, j, _, _) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            c = cells(i, j)
            update = RATE * _grid(*(grid(np.bincount(c, v, PAIR_BINS**2)) for v in (y - p, p * (1 - p), np.ones(n))))
            model.pair_tables[k] += update
            total += update.ravel()[c]
    return model


def _features_of(rows: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    names = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (id_col, *more))

    def start():
        def step(batch):
            for key, text, *rest in batch:
                yield (key, *rest, text_features(text))

        return step

    return map_rows(rows.select(id_col, text_col, *more), f"{names}, features array<double>", start)


def train_quality(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", folds: int = 5, held_out: int = 0,
) -> AdditiveModel:
    """Fit on at most sample_rows labelled rows outside the held-out fold, chosen by a keyed hash of the id.

    Null labels and null ids are no labelled rows; of an id's repeated labels the largest counts, of its repeated rows the one with
    the smallest features, so that at most sample_rows rows reach the driver. Without labelled rows the score is a constant.
    """
    picked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != held_out))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit("sample"), "id"), "id")
        .limit(sample_rows)
    )
    # At most sample_rows rows of two numbers.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    found = _features_of(rows, "id", "text", "label").groupBy("id", "label").agg(F.min("features").alias("features")).collect()
    found.sort(key=lambda r: r["id"])
    x = np.array([r["features"] for r in found], dtype=float).reshape(len(found), len(FEATURES))
    return fit_additive(x, np.array([r["label"] for r in found], dtype=float))


def score_quality(
    docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF,
    folds: int = 5, held_out: int = 0, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, held_out, score, predicted, *carry), a row per input row, without a shuffle.

    The score depends on the text alone: equal texts score equally, null and empty ones like a text whose
    features are all 0. Repeated rows and null ids are scored like others. An empty table gives no rows.
    """
    own = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (crc_mod(id_col, folds) == held_out).alias("_held"),
        *(F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)),
    )
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def start():
        def step(rows):
            rows = list(rows)
            x = np.array([text_features(r[1]) for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
            for (key, _, held, *rest), score in zip(rows, model.score(x)):
                yield (key, bool(held), float(score), int(score >= cutoff), *rest)

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(own, f"`{id_col}` {kind}, held_out boolean, score double, predicted int{kinds}", start)
