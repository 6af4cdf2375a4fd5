import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import quality_gam as G

from .conftest import frame


def test_features_of_odd_texts(odd_texts):
    x = G.features(pa.array(odd_texts))
    assert np.isfinite(x).all() and (x[:3] == 0).all() and x.shape == (7, len(G.FEATURES))


def test_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, len(G.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = G.fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) > 0.5) == (y[3000:] == 1)).mean() > 0.95
    assert (0, 1) in [(a, b) for a, b, _ in model.pairs]


def test_score_is_a_sum_of_table_entries():
    r = np.random.default_rng(1)
    x, y = r.random((500, len(G.FEATURES))), r.integers(0, 2, 500).astype(float)
    m = G.fit(x, y)
    row = x[3]
    z = m.base + sum(t[np.searchsorted(c, v, side="right")] for c, t, v in zip(m.cuts, m.tables, row, strict=True))
    z += sum(t[np.searchsorted(m.pair_cuts[a], row[a], side="right"), np.searchsorted(m.pair_cuts[b], row[b], side="right")] for a, b, t in m.pairs)
    assert m.logits(row[None])[0] == pytest.approx(z)


@pytest.mark.parametrize("y", [[], [1, 1, 1], [0]])
def test_one_class_or_none(y):
    m = G.fit(np.zeros((len(y), len(G.FEATURES))), np.array(y, float))
    assert ((0 < m.scores(np.zeros((2, len(G.FEATURES))))) & (m.scores(np.zeros((2, len(G.FEATURES)))) < 1)).all()


def test_held_out_accuracy(spark, prose, odd_texts):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        text = prose(r.randint(20, 300), i)
        rows.append((i, text if good else " ".join(w + "***" for w in text.split())))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, t) for i, t in enumerate(odd_texts)] + [(None, "x"), (3, "again")]
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels + [(5, None, 0)], "doc_id bigint, quality int, toxic int")
    got = G.score_documents(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got)
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    truth = {i: q for i, q, _ in labels}
    held = [g for g in got if g.held_out and g.doc_id in truth and g.doc_id != 3]
    assert len(held) > 80 and np.mean([g.predicted == truth[g.doc_id] for g in held]) > 0.97


def test_labels_of_the_held_fold_change_nothing(spark, prose):
    rows = [(i, prose(40, i)) for i in range(60)]
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    a = [(i, i % 2, 0) for i in range(60)]
    b = [(i, 1 - q if i in held else q, 0) for i, q, _ in a]
    score = lambda marks: sorted((g.doc_id, g.score) for g in G.score_documents(frame(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")).collect())
    assert score(a) == score(b)


def test_empty_tables(spark):
    docs = frame(spark, [(1, "a")])
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert G.score_documents(docs, marks).count() == 1 and G.score_documents(docs.limit(0), marks).count() == 0


def test_copies_of_one_id_crowd_out_no_other(spark, prose, monkeypatch):
    rows = [(0, prose(20, i)) for i in range(60)] + [(i, prose(20, 100 + i)) for i in (1, 8, 9)]
    marks = spark.createDataFrame([(0, 0), (1, 0), (8, 1), (9, 1)], "doc_id bigint, label int")
    monkeypatch.setattr(G, "fit", lambda x, y, settings: y.tolist())
    assert G.learn(frame(spark, rows), marks, G.GamSettings(sample=4)) == [0, 0, 1, 1]
