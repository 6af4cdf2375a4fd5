import random
import zlib

import numpy as np
import pytest

from quillon.llm import toxicity as X

from .conftest import frame

SMALL = X.ToxicSettings(epochs=4, word_rows=1 << 10, char_rows=1 << 12, batch=64)


def planted(prose, n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(r.choice([5, 30, 200]), seed * 1000 + i).split()
        bad = r.random() < 0.4
        if bad:
            for _ in range(1 + len(words) // 40):
                words.insert(r.randrange(len(words) + 1), r.choice(["Zrotten", "zrotter,", "ZROTTED", "quxvile"]))
        out.append((" ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def net(prose):
    rows = planted(prose, 700, 1)
    return X.train([t for t, _ in rows], np.array([y for _, y in rows]), SMALL)


def test_unseen_forms_are_caught_by_characters(net, prose):
    rows = planted(prose, 300, 2)
    p, y = X.Scorer(net).scores([t for t, _ in rows]), np.array([y for _, y in rows])
    assert ((p >= 0.7) == (y == 1)).mean() > 0.93
    assert X.Scorer(net).scores([prose(60, 3) + " zrottenest " + prose(60, 4)])[0] > 0.5


def test_gradients():
    s = X.ToxicSettings(window=5, hidden=3, word_size=3, char_size=3, word_rows=16, char_rows=32)
    net = X.Network.fresh(s)
    net.p = {k: v.astype(np.float64) * 3 for k, v in net.p.items()}
    words = [b"alpha", b"be", b"gamma"]
    rows, grams = X.hashed_words(words, s)
    r = np.random.default_rng(0)
    index, there = r.integers(0, 3, (5, 4)), np.ones((5, 4), bool)
    there[3:, 1], there[1:, 2] = False, False
    y, weight = np.array([1.0, 0, 1, 0]), np.array([0.3, 0.2, 0.4, 0.1])

    def loss():
        x = net.inputs(rows, grams)[index].astype(np.float64)
        z = net.run({w: x @ net.p[f"W{w}"] + net.p[f"b{w}"] for w in "fb"}, there)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    g = net.learn_batch(rows, grams, index, there, y, weight)
    for k in ("Wf", "Ub", "A", "a", "v", "bf"):
        at = tuple(0 for _ in net.p[k].shape)
        kept, step = net.p[k][at], 1e-3
        net.p[k][at] = kept + step
        up = loss()
        net.p[k][at] = kept - step
        down = loss()
        net.p[k][at] = kept
        assert g[k][at] == pytest.approx((up - down) / 2 / step, rel=0.05, abs=2e-4), k


def test_windows_cover_every_word():
    for n in (1, 23, 24, 25, 36, 37, 100):
        starts = X.window_starts(n, 24, 12)
        assert {w for a in starts for w in range(a, min(n, a + 24))} == set(range(n))
        assert all(b - a <= 12 for a, b in zip(starts, starts[1:], strict=False))


def test_any_place_of_a_long_text_counts(net, prose, odd_texts):
    clean = prose(3000, 8).split()
    for at in (0, 1500, 3000):
        assert X.Scorer(net).scores([" ".join([*clean[:at], "zrotten quxvile zrotter", *clean[at:]])])[0] > 0.7
    p = X.Scorer(net).scores([*odd_texts, "x" * 100_000])
    assert np.isfinite(p).all() and (p[:3] == 0).all()


def test_batches_and_memory_change_nothing(net, prose, monkeypatch):
    texts = [prose(n, n) for n in (3, 30, 500, 24, 23, 60)]
    whole = X.Scorer(net).scores(texts)
    monkeypatch.setattr(X.Scorer, "KEPT", 50)
    one = X.Scorer(net)
    assert np.allclose(whole, [one.scores([t])[0] for t in texts], atol=1e-5)


@pytest.mark.parametrize("labels", [[], [1], [0, 0]])
def test_one_class_or_none(labels):
    net = X.train(["a b"] * len(labels), np.array(labels, int), SMALL)
    assert X.Scorer(net).scores(["anything", None])[0] < 0.5


def test_documents(spark, prose, odd_texts):
    planted_rows = planted(prose, 300, 5)
    rows = [(i, t) for i, (t, _) in enumerate(planted_rows)] + [(1000 + i, t) for i, t in enumerate(odd_texts)] + [(None, "x"), (1, "again")]
    marks = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(planted_rows)], "doc_id bigint, quality int, toxic int")
    got = X.score_documents(frame(spark, rows), marks, settings=SMALL).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g in got)
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got)
    held = [g for g in got if g.held_out and g.doc_id < 300 and g.doc_id != 1]
    assert np.mean([g.predicted == planted_rows[g.doc_id][1] for g in held]) > 0.85
    assert X.score_documents(frame(spark, rows[:2]).limit(0), marks, settings=SMALL).count() == 0


def test_copies_of_one_id_crowd_out_no_other(spark, monkeypatch):
    rows = [(0, f"clean {i}") for i in range(60)] + [(1, "clean"), (8, "toxic"), (9, "toxic too")]
    marks = spark.createDataFrame([(0, 0), (1, 0), (8, 1), (9, 1)], "doc_id bigint, label int")
    monkeypatch.setattr(X, "train", lambda texts, labels, settings: (texts, labels.tolist()))
    texts, labels = X.learn(frame(spark, rows), marks, X.ToxicSettings(sample_clean=2, sample_toxic=2))
    assert labels == [0, 0, 1, 1] and texts[1:] == ["clean", "toxic", "toxic too"]
