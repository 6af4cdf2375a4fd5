"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its word vector and the sum of its character n-gram vectors, both from hashed tables.  Two GRUs read a
window of words from either end; attention weighs their joint states, and the pooled state gives the window's logit.  All
windows of a text are scored, each half overlapping the next; the largest logit, calibrated on documents that the network
was not trained on, is the document's.

The network learns from whole documents' labels: at first from those windows of toxic documents that hold the words which
speak most for that class, then from those that the network itself finds the most toxic.  Its sample of labelled rows is bounded; scoring is not bounded by anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.quality_gam import fold

WORD_BYTES = 32  # a longer word is read as several


@dataclass(frozen=True)
class ToxicSettings:
    sample_toxic: int = 800  # labelled rows of each class that the fit takes at most, those of the least hash
    sample_clean: int = 1600
    windows_per_clean: int = 12  # of a clean training document, spread evenly; a toxic one gives all
    window: int = 24
    step: int = 12
    hidden: int = 12
    word_rows: int = 1 << 14
    char_rows: int = 1 << 15
    word_size: int = 12
    char_size: int = 12
    epochs: int = 6
    least_documents: int = 3  # a table row that fewer training documents touch stays zero: it could only be learned by heart
    least_steps: int = 700  # small samples are read more often, up to most_epochs
    most_epochs: int = 40
    batch: int = 256
    rate: float = 0.01
    top_share: float = 0.25  # of a toxic document's windows, at first
    calibration: float = 0.2  # of the sample, held back
    seed: int = 7


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space, long ones in pieces."""
    out = (text or "").lower().encode("utf-8", "replace").split()
    if any(len(w) > WORD_BYTES for w in out):
        out = [w[i : i + WORD_BYTES] for w in out for i in range(0, len(w), WORD_BYTES)]
    return out


def hashed_words(words: list[bytes], s: ToxicSettings) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the word table, and rows of the character table (-1: none): n-grams of 3, 4 and 5 bytes with the word's ends.

    Punctuation at a word's ends is dropped first.
    """
    bare = [w.strip(b".,;:!?\"'()[]{}*%$&#|") for w in words]
    wide = WORD_BYTES + 2
    padded = np.zeros((len(words), wide), np.uint64)
    raw = np.frombuffer(b"".join(b"<" + w + b">" + bytes(wide - 2 - len(w)) for w in bare), np.uint8).reshape(len(words), wide)
    padded[:] = raw
    lengths = np.fromiter((len(w) + 2 for w in bare), np.int64, len(bare))
    powers = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, wide + 1, dtype=np.uint64)
    whole = mix((padded * powers).sum(1))
    grams = []
    for n in (3, 4, 5):
        h = sum(padded[:, k : wide - n + 1 + k] * powers[k] for k in range(n)) + np.uint64(n)
        rows = (mix(h) % np.uint64(s.char_rows)).astype(np.int32)
        rows[np.arange(rows.shape[1])[None, :] + n > lengths[:, None]] = -1
        grams.append(rows)
    return (whole % np.uint64(s.word_rows)).astype(np.int32), np.hstack(grams)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Network:
    settings: ToxicSettings
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0  # calibration of a document's largest logit
    shift: float = 0.0

    @classmethod
    def fresh(cls, s: ToxicSettings) -> Network:
        r = np.random.default_rng(s.seed)
        d, h = s.word_size + s.char_size, s.hidden
        make = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        p = {"word": make(s.word_rows, s.word_size, by=0.1), "char": make(s.char_rows, s.char_size, by=0.1)}
        for way in "fb":
            p |= {f"W{way}": make(d, 3 * h, by=d**-0.5), f"U{way}": make(h, 3 * h, by=h**-0.5), f"b{way}": np.zeros(3 * h, np.float32)}
        p |= {"A": make(2 * h, h, by=(2 * h) ** -0.5), "a": make(h, by=h**-0.5), "v": make(2 * h, by=(2 * h) ** -0.5), "c": np.zeros(1, np.float32)}
        return cls(s, p)

    def inputs(self, rows: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Input vectors of words: word vector, then the mean of the n-gram vectors."""
        there = grams >= 0
        table = self.p["char"]
        n = np.maximum(there.sum(1), 1).astype(np.float32)
        chars = np.empty((len(rows), self.settings.char_size), np.float32)
        for at in range(0, len(rows), 4096):  # bounds the gathered n-gram vectors
            part = slice(at, at + 4096)
            chars[part] = np.einsum("wgc,wg->wc", table[grams[part]], there[part].astype(np.float32))
        return np.hstack([self.p["word"][rows], chars / np.sqrt(n)[:, None]])

    def run(self, gates: dict[str, np.ndarray], there: np.ndarray | None, keep: bool = False):
        """Logits of windows.  gates: for each way the input part of the gates, (steps, windows, 3 hidden); there: 1 where
        a step has a word, None where all have."""
        h, states, kept = self.settings.hidden, {}, {}
        for way in "fb":
            x, u = gates[way], self.p[f"U{way}"]
            steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
            now = np.zeros((x.shape[1], h), np.float32)
            out = np.empty((len(x), x.shape[1], h), np.float32)
            trace = []
            for t in steps:
                inner = now @ u
                zr = 1 / (1 + np.exp(-(x[t][:, : 2 * h] + inner[:, : 2 * h])))
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(x[t][:, 2 * h :] + r * inner[:, 2 * h :])
                new = n + z * (now - n)
                if there is not None:
                    new = np.where(there[t][:, None], new, now)
                if keep:
                    trace.append((t, now, inner[:, 2 * h :], z, r, n))
                out[t] = now = new
            states[way], kept[way] = out, trace
        both = np.concatenate([states["f"], states["b"]], axis=2)
        mid = np.tanh(both @ self.p["A"])
        e = mid @ self.p["a"]
        if there is not None:
            e = np.where(there, e, np.float32(-1e9))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (both * w[:, :, None]).sum(0)
        logit = pooled @ self.p["v"] + self.p["c"]
        return (logit, both, mid, w, pooled, kept) if keep else logit

    def learn_batch(self, rows: np.ndarray, grams: np.ndarray, index: np.ndarray, there: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss.  index: (steps, windows) into the distinct words rows, grams."""
        p, h, s = self.p, self.settings.hidden, self.settings
        x = self.inputs(rows, grams)
        xs = x[index]
        gates = {way: xs @ p[f"W{way}"] + p[f"b{way}"] for way in "fb"}
        logit, both, mid, w, pooled, kept = self.run(gates, there, keep=True)
        d = (1 / (1 + np.exp(-logit)) - y) * weight
        g = {"c": np.array([d.sum()], np.float32), "v": pooled.T @ d}
        dpool = d[:, None] * p["v"]
        dboth = w[:, :, None] * dpool
        dw = (both * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        g["a"] = np.einsum("twh,tw->h", mid, de)
        dmid = de[:, :, None] * p["a"] * (1 - mid * mid)
        g["A"] = np.einsum("twi,twj->ij", both, dmid, optimize=True)
        dboth += dmid @ p["A"].T
        dx = np.zeros_like(xs)
        for k, way in enumerate("fb"):
            u, dgates = p[f"U{way}"], np.empty_like(gates[way])
            gu, carry = np.zeros_like(u), np.zeros((xs.shape[1], h), np.float32)
            for t, before, un, z, r, n in reversed(kept[way]):
                dh = carry + dboth[t][:, k * h : (k + 1) * h]
                on = there[t][:, None]
                live = dh * on
                dz = live * (before - n) * z * (1 - z)
                dn = live * (1 - z) * (1 - n * n)
                dr = dn * un * r * (1 - r)
                inner = np.concatenate([dz, dr, dn * r], axis=1)
                dgates[t] = np.concatenate([dz, dr, dn], axis=1)
                gu += before.T @ inner
                carry = np.where(on, live * z, dh) + inner @ u.T
            flat = dgates.reshape(-1, 3 * h)
            g[f"U{way}"], g[f"W{way}"], g[f"b{way}"] = gu, xs.reshape(-1, xs.shape[2]).T @ flat, flat.sum(0)
            dx += dgates @ p[f"W{way}"].T
        dwords = np.zeros_like(x)
        np.add.at(dwords, index.ravel(), dx.reshape(-1, dx.shape[2]))
        g["word"] = (rows, dwords[:, : s.word_size])
        there_g = grams >= 0
        n = np.sqrt(np.maximum(there_g.sum(1), 1)).astype(np.float32)
        where, column = np.nonzero(there_g)
        g["char"] = (grams[where, column], (dwords[:, s.word_size :] / n[:, None])[where])
        return g


class Adam:
    """Adam; tables get the updates of their learned rows alone."""

    def __init__(self, p: dict[str, np.ndarray], rate: float, learned: dict[str, np.ndarray]):
        self.p, self.rate, self.t, self.learned = p, rate, 0, learned
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        a, b = 1 - 0.9**self.t, 1 - 0.999**self.t
        for k, grad in g.items():
            if isinstance(grad, tuple):
                on = self.learned[k][grad[0]]
                rows, back = np.unique(grad[0][on], return_inverse=True)
                total = np.zeros((len(rows), grad[1].shape[1]), np.float32)
                np.add.at(total, back, grad[1][on])
                grad, at = total, rows
            else:
                at = slice(None)
            self.m[k][at] += 0.1 * (grad - self.m[k][at])
            self.v[k][at] += 0.001 * (grad * grad - self.v[k][at])
            self.p[k][at] -= self.rate * (self.m[k][at] / a) / (np.sqrt(self.v[k][at] / b) + 1e-6)


def window_starts(n: int, window: int, step: int) -> list[int]:
    """Starts of windows that cover n words, each overlapping the next; the last ends at the last word."""
    if n <= window:
        return [0]
    return [*range(0, n - window, step), n - window]


class Scorer:
    """Scores texts with a trained network; keeps the input part of the gates of words it has seen, in bounded memory."""

    KEPT = 200_000

    def __init__(self, network: Network):
        self.net, self.at = network, {}
        width = 6 * network.settings.hidden
        self.table = np.zeros((1 << 12, width), np.float32)

    def rows(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Table rows of the words of each text.  Rows given out before hold no longer once the table has been emptied."""
        at, seen = self.at, set().union(*texts)
        new = [w for w in seen if w not in at]
        if at and len(at) + len(new) > self.KEPT:
            at.clear()
            new = list(seen)
        n = len(at)
        if len(self.table) < n + len(new):
            grown = np.zeros((max(2 * len(self.table), n + len(new)), self.table.shape[1]), np.float32)
            grown[:n] = self.table[:n]
            self.table = grown
        p = self.net.p
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            x = self.net.inputs(*hashed_words(part, self.net.settings))
            self.table[n + k : n + k + len(part)] = np.hstack([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]])
        at.update(zip(new, range(n, n + len(new)), strict=True))
        return [np.fromiter(map(at.__getitem__, words), np.int32, len(words)) for words in texts]

    def window_logits(self, index: np.ndarray, there: np.ndarray | None) -> np.ndarray:
        """index: (windows, steps) of table rows."""
        h3 = 3 * self.net.settings.hidden
        out = np.empty(len(index), np.float32)
        for a in range(0, len(index), 2048):
            got = self.table[index[a : a + 2048].T]
            on = None if there is None else there[a : a + 2048].T
            out[a : a + 2048] = self.net.run({"f": got[:, :, :h3], "b": got[:, :, h3:]}, on)
        return out

    def largest(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text; -inf where there are no words."""
        s = self.net.settings
        best = np.full(len(texts), -np.inf, np.float32)
        split = [words_of(t) for t in texts]
        group, size = [], 0
        for i, words in enumerate(split):
            group += [i] if words else []
            size += len(words)
            if group and (size >= 50_000 or i + 1 == len(split)):
                self._group(group, [split[k] for k in group], best)
                group, size = [], 0
        if group:
            self._group(group, [split[k] for k in group], best)
        return best

    def _group(self, owners: list[int], texts: list[list[bytes]], best: np.ndarray) -> None:
        s, steps = self.net.settings, np.arange(self.net.settings.window)
        short, full, owner = [], [], []
        for i, got in zip(owners, self.rows(texts), strict=True):
            if len(got) < s.window:
                short.append((i, got))
                continue
            starts = np.array(window_starts(len(got), s.window, s.step))
            for a in range(0, len(starts), 8192):  # a very long text in parts
                full.append(got[starts[a : a + 8192, None] + steps])
                owner.append(np.full(len(full[-1]), i))
                if len(full[-1]) == 8192:
                    np.maximum.at(best, np.concatenate(owner), self.window_logits(np.concatenate(full), None))
                    full, owner = [], []
        if full:
            np.maximum.at(best, np.concatenate(owner), self.window_logits(np.concatenate(full), None))
        if short:
            index, there = np.zeros((len(short), s.window), np.int32), np.zeros((len(short), s.window), bool)
            for j, (_, got) in enumerate(short):
                index[j, : len(got)], there[j, : len(got)] = got, True
            best[[i for i, _ in short]] = self.window_logits(index, there)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1; 0 for texts without words."""
        z = self.largest(texts).astype(float)
        out = 1 / (1 + np.exp(-np.clip(self.net.scale * np.where(np.isfinite(z), z, 0) + self.net.shift, -40, 40)))
        return np.where(np.isfinite(z), out, 0.0)


def train(texts: list[str], labels: np.ndarray, s: ToxicSettings = ToxicSettings()) -> Network:
    """Learns from whole texts and their labels (0 or 1); without both classes every score is that of no evidence."""
    net = Network.fresh(s)
    if len(labels) == 0 or labels.min() == labels.max():
        net.scale, net.shift = 0.0, -4.0
        return net
    r = np.random.default_rng(s.seed)
    number: dict[bytes, int] = {}
    index, there, owner, texts_words = [], [], [], []
    held_back = np.zeros(len(labels), bool)
    for c in (0, 1):
        mine = np.flatnonzero(labels == c)
        held_back[r.permutation(mine)[: int(len(mine) * s.calibration)]] = True
    for i, text in enumerate(texts):
        words = words_of(text)
        if not words or held_back[i]:
            continue
        ids = np.array([number.setdefault(w, len(number)) for w in words])
        texts_words.append((int(labels[i]), np.unique(ids)))
        starts = window_starts(len(ids), s.window, s.step)
        if labels[i] == 0 and len(starts) > s.windows_per_clean:
            starts = [starts[k] for k in np.linspace(0, len(starts) - 1, s.windows_per_clean).astype(int)]
        for a in starts:
            part = ids[a : a + s.window]
            index.append(np.pad(part, (0, s.window - len(part))))
            there.append(np.arange(s.window) < len(part))
            owner.append(i)
    index, there, owner = np.array(index).reshape(-1, s.window), np.array(there).reshape(-1, s.window), np.array(owner, int)
    if not len(index):
        net.scale, net.shift = 0.0, -4.0
        return net
    rows, grams = (np.concatenate(x) for x in zip(*(hashed_words(list(number)[k : k + 4096], s) for k in range(0, len(number), 4096)), strict=True))
    learned, odds = {}, np.full(len(number), -np.inf)
    for table, of_word in (("word", rows[:, None]), ("char", grams)):
        touched = np.zeros((2, len(net.p[table]) + 1))  # documents of either class; the last row takes what is no row
        for label, ids in texts_words:
            seen = np.zeros(touched.shape[1], bool)
            seen[of_word[ids].ravel()] = True
            touched[label] += seen
        learned[table] = touched.sum(0)[:-1] >= s.least_documents
        net.p[table][~learned[table]] = 0
        n = np.bincount([label for label, _ in texts_words], minlength=2)[:, None]
        share = np.log((touched + 0.5) / (n + 1))
        share[:, -1] = 0
        for at in range(0, len(odds), 4096):
            odds[at : at + 4096] = np.maximum(odds[at : at + 4096], (share[1] - share[0])[of_word[at : at + 4096]].max(1))
    # where the network starts from: the windows with the word that speaks most for its document's class
    first = np.where(there, odds[index], -np.inf).max(1)
    adam, toxic = Adam(net.p, s.rate, learned), labels[owner] == 1

    def logits_of_all() -> np.ndarray:
        x = net.inputs(rows, grams)
        out = np.empty(len(index), np.float32)
        for a in range(0, len(index), 2048):
            xs = x[index[a : a + 2048].T]
            out[a : a + 2048] = net.run({w: xs @ net.p[f"W{w}"] + net.p[f"b{w}"] for w in "fb"}, there[a : a + 2048].T)
        return out

    epochs = min(max(s.epochs, -(-s.least_steps * s.batch // len(index))), max(s.epochs, s.most_epochs))
    for epoch in range(epochs):
        done = epoch / epochs
        adam.rate = s.rate * (1 - done * 0.8)
        z = logits_of_all() if epoch else first
        use = ~toxic
        order = np.lexsort((-z, owner))
        at = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
        place = np.arange(len(order)) - np.repeat(at, np.diff(np.r_[at, len(order)]))
        count = np.bincount(owner, minlength=len(labels))
        use[order[place < np.maximum(1, s.top_share / (1 + 5 * done) * count[owner[order]])]] = True
        chosen = r.permutation(np.flatnonzero(use))
        positive = toxic[chosen].mean()
        for a in range(0, len(chosen), s.batch):
            part = chosen[a : a + s.batch]
            y = toxic[part].astype(np.float32)
            weight = np.where(y == 1, 0.5 / max(positive, 1e-3), 0.5 / max(1 - positive, 1e-3)).astype(np.float32) / len(part)
            words, back = np.unique(index[part].T, return_inverse=True)
            adam.step(net.learn_batch(rows[words], grams[words], back.reshape(s.window, -1), there[part].T, y, weight))
    calibrate(net, texts, labels, held_back if held_back.sum() >= 20 and 0 < labels[held_back].mean() < 1 else np.ones(len(labels), bool))
    return net


def calibrate(net: Network, texts: list[str], labels: np.ndarray, use: np.ndarray) -> None:
    """Fits scale and shift of the documents' largest logits by damped Newton steps with a weak prior."""
    z = Scorer(net).largest([t for t, u in zip(texts, use, strict=True) if u]).astype(float)
    y, on = labels[use], np.isfinite(z)
    z, y = z[on], y[on]
    middle, spread = z.mean(), z.std() + 1e-6
    x, w = np.column_stack([(z - middle) / spread, np.ones_like(z)]), np.zeros(2)
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * w @ w * 0.1
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (y - p) - 0.1 * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
    if w[0] > 0:
        net.scale, net.shift = float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def score_column(text: Column, network: Network) -> Column:
    """The score of a text; only texts go to the workers, so rows and their other columns stay where they are."""
    shared = SparkContext._active_spark_context.broadcast(network)  # of the settings' size

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.scores(batch.slice(a, 512).to_pylist()) for a in range(0, len(batch), 512)]
            yield pa.array(np.concatenate(found or [np.empty(0)]), pa.float64())

    return run(text)


def learn(docs: DataFrame, labels: DataFrame, settings: ToxicSettings = ToxicSettings()) -> Network:
    """Trains on labelled rows of docs: a bounded number of each class, those whose ids hash least."""
    marked = labels.filter("label in (0, 1)").select("doc_id", "label").distinct()
    take = F.xxhash64("doc_id")
    ids = [marked.filter(F.col("label") == c).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(take, "doc_id").limit(n) for c, n in ((0, settings.sample_clean), (1, settings.sample_toxic))]
    few = F.broadcast(ids[0].unionByName(ids[1]))  # of the sample's size
    # a repeated id gives one row to each of its labels, so its copies can't crowd out other ids
    rows = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy("doc_id", "label").collect()
    return train([r["text"] for r in rows], np.array([r["label"] for r in rows], int), settings)


def trained(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, settings: ToxicSettings = ToxicSettings()) -> tuple[Network, Column]:
    """A network of the labels (doc_id, toxic) of all folds of ids but one, and whether a row is of that one."""
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_fold, F.lit(False))
    return learn(docs.filter(~held), labels.select("doc_id", F.col("toxic").alias("label")), settings), held


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, threshold: float = 0.7, settings: ToxicSettings = ToxicSettings()) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted.  labels: (doc_id, toxic).

    Null, empty and blank texts score 0; a null doc_id is never held out and has no label; repeated rows get one score.
    """
    network, held = trained(docs, labels, folds, held_fold, settings)
    scored = docs.select("doc_id", held.alias("held_out"), score_column(F.col("text"), network).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
