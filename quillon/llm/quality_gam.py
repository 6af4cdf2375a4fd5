"""Quality classifier: a generalised additive model with pairwise interactions.

Twelve counts of a text, each cut into bins, index lookup tables; the tables' entries add up to a logit.  Tables are
learned by cyclic boosting: round after round, each feature in turn gets a shallow tree over its own bins, fitted to the
gradient of the logistic loss, which is added to its table; then the pairs whose trees reduce the loss most get tables of
two dimensions in the same way.  A score is a sum of lookups, over a whole batch at once.

Features come from every whole text in one pass, by one lookup of each byte's class.  The fit takes a bounded sample of
labelled rows; nothing else depends on their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("log_words", "word_length", "symbols", "capitals", "bars", "shouts", "stops", "digits", "blanks", "new_words", "repeated_lines", "line_words")

OTHER, LETTER, CAPITAL, DIGIT, SPACE, LINE, SYMBOL, BAR, SHOUT, STOP, INNER = range(11)


@dataclass(frozen=True)
class GamSettings:
    sample: int = 20_000  # labelled rows that the fit takes at most, those of the least hash
    bins: int = 32
    rounds: int = 150
    rate: float = 0.15
    leaves: int = 4
    pairs: int = 6
    pair_rounds: int = 40
    pair_bins: int = 8
    shrink: float = 4.0  # added to each leaf's curvature


def byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", LETTER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", CAPITAL), ("0123456789", DIGIT), (" \t\x0b\x0c\r", SPACE), ("\n", LINE), ("#$%&*<>@^_~`=+\\/[]{}", SYMBOL), ("|", BAR), ("!?", SHOUT), (".,;:", STOP)):
        table[np.frombuffer(chars.encode(), np.uint8)] = kind
    table[0x80:0xC0] = INNER  # bytes of a character after its first
    table[0xC0:] = LETTER
    return table


CLASSES = byte_classes()


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; null and empty texts have zeros."""
    texts = texts.cast(pa.large_binary())
    out = np.zeros((len(texts), len(FEATURES)))
    for i, one in enumerate(texts):
        whole = one.as_py() or b""
        words = whole.split()
        if not words:
            continue
        n = np.bincount(CLASSES[np.frombuffer(whole, np.uint8)], minlength=11)
        chars = len(whole) - n[INNER]
        lines = [x for x in whole.split(b"\n") if x.strip()]
        letters = n[LETTER] + n[CAPITAL] + n[OTHER]
        solid = chars - n[SPACE] - n[LINE]
        out[i] = (
            np.log1p(len(words)),
            solid / len(words),
            n[SYMBOL] / len(words),
            n[CAPITAL] / max(letters, 1),
            n[BAR] / len(words),
            n[SHOUT] / len(words),
            n[STOP] / len(words),
            n[DIGIT] / solid,
            (n[SPACE] + n[LINE]) / chars,
            len(set(words)) / len(words) ** 0.9,
            1 - len(set(lines)) / len(lines),
            np.log1p(len(words) / len(lines)),
        )
    return out


@dataclass
class Gam:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)  # of each feature, ascending
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cut, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += t[np.searchsorted(cut, x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(cut, x[:, j], side="right") for j, cut in enumerate(self.pair_cuts)]
            for a, b, t in self.pairs:
                z += t[coarse[a], coarse[b]]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def tree_over_bins(g: np.ndarray, h: np.ndarray, leaves: int, shrink: float) -> np.ndarray:
    """Values of a tree that cuts a run of bins into leaves, best cut first; g, h: gradient and curvature of each bin."""
    parts = [(0, len(g))]
    gain = lambda a, b: a * a / (b + shrink)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p in parts:
            a, b = p
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            gt, ht = g[a:b].sum(), h[a:b].sum()
            won = gain(gl, hl) + gain(gt - gl, ht - hl) - gain(gt, ht)
            k = int(np.argmax(won))
            if won[k] > best[0]:
                best = (won[k], p, a + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + shrink)
    return out


def tree_over_pair(g: np.ndarray, h: np.ndarray, shrink: float) -> tuple[np.ndarray, float]:
    """Values and gain of the best tree with one cut of either dimension: four leaves."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    quarters = []
    for c in (cg, ch):
        ll = c[1:-1, 1:-1]
        lr, rl = c[1:-1, -1:] - ll, c[-1:, 1:-1] - ll
        quarters.append((ll, lr, rl, c[-1, -1] - ll - lr - rl))
    won = sum(a * a / (b + shrink) for a, b in zip(*quarters, strict=True))
    i, j = np.unravel_index(np.argmax(won), won.shape)
    out = np.empty_like(g)
    for k, (rows, columns) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, columns] = quarters[0][k][i, j] / (quarters[1][k][i, j] + shrink)
    return out, float(won[i, j])


def fit(x: np.ndarray, y: np.ndarray, s: GamSettings = GamSettings()) -> Gam:
    """Learns from rows x with labels y (0 or 1).  Without rows the score is one half, with one class close to it."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    d = x.shape[1]
    model.cuts = [quantile_cuts(x[:, j], s.bins) for j in range(d)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    z = np.full(len(y), model.base)

    def slope(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(s.rounds):
        for j in range(d):
            g, h = slope(z)
            n = len(model.tables[j])
            step = s.rate * tree_over_bins(np.bincount(at[j], g, n), np.bincount(at[j], h, n), s.leaves, s.shrink)
            model.tables[j] += step
            z += step[at[j]]
    model.pair_cuts = [quantile_cuts(x[:, j], s.pair_bins) for j in range(d)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        n, m = len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1
        return np.bincount(coarse[a] * m + coarse[b], v, n * m).reshape(n, m)

    g, h = slope(z)
    gains = {(a, b): tree_over_pair(grid(a, b, g), grid(a, b, h), s.shrink)[1] for a in range(d) for b in range(a + 1, d)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[: s.pairs]
    tables = {p: np.zeros((len(model.pair_cuts[p[0]]) + 1, len(model.pair_cuts[p[1]]) + 1)) for p in chosen}
    for _ in range(s.pair_rounds):
        for a, b in chosen:
            g, h = slope(z)
            step = s.rate * tree_over_pair(grid(a, b, g), grid(a, b, h), s.shrink)[0]
            tables[a, b] += step
            z += step[coarse[a], coarse[b]]
    model.pairs = [(a, b, tables[a, b]) for a, b in chosen]
    return model


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string")) % parts


def learn(docs: DataFrame, labels: DataFrame, settings: GamSettings = GamSettings()) -> Gam:
    """Fits to rows of docs that have a label (doc_id, label); a document with both labels gives both.

    The sample's ids are chosen first, and their number is the setting's, so they are sent to the executors; only features
    of the sample's texts come back.
    """
    marked = labels.filter("label in (0, 1)").select("doc_id", "label").distinct()
    known = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    few = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(settings.sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), flat], ["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", "text").join(few.withColumn("label", F.col("label").cast("int")), "doc_id")
    found = chosen.select("doc_id", "label", "text").mapInArrow(run, f"doc_id {kind}, label int, x array<double>")
    # a repeated id gives one row to each of its labels, so its copies can't crowd out other ids
    rows = found.groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id", "label").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], float), settings)


def score_column(text: Column, model: Gam) -> Column:
    """The score of a text, by whole batches; only texts go to the workers, so rows and their other columns stay where they
    are."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(features(texts)), pa.float64())

    return run(text)


def trained(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, settings: GamSettings = GamSettings()) -> tuple[Gam, Column]:
    """A model of the labels (doc_id, quality) of all folds of ids but one, and whether a row is of that one."""
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_fold, F.lit(False))
    return learn(docs.filter(~held), labels.select("doc_id", F.col("quality").alias("label")), settings), held


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, threshold: float = 0.3, settings: GamSettings = GamSettings()) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted.  labels: (doc_id, quality).

    Null and empty texts have the features zero and are scored like any other; a null doc_id is never held out and has no
    label; repeated rows get the same score.
    """
    model, held = trained(docs, labels, folds, held_fold, settings)
    scored = docs.select("doc_id", held.alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
