import random

import corpus_pipeline
import numpy as np
import pytest

from quillon.llm import near_copies as N

from .conftest import frame


def sets(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)} - {()}


def brute_kept(rows, least=0.8):
    """Ids kept: the least of each connected class of similar texts."""
    texts, left, kept = [sets(t) for _, t in rows], set(range(len(rows))), []
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            x = texts[todo.pop()]
            near = [b for b in left if x == texts[b] or len(x & texts[b]) / (len(x | texts[b]) or 1) >= least]
            left -= set(near)
            todo += near
            group += near
        kept.append(min(rows[g][0] for g in group))
    return sorted(kept)


def edited(r, text, times):
    words = text.split()
    for at in r.sample(range(len(words)), times):
        words[at] = f"x{r.randrange(10**9)}"
    return " ".join(words)


def test_stage_finds_near_copies_far_beyond_two_bits(spark, sf_dir, prose):
    r, rows = random.Random(4), []
    for i in range(12):
        base = prose(300, 100 + i)
        rows += [(10 * i, base), (10 * i + 1, edited(r, base, 5)), (10 * i + 2, edited(r, base, 20))]  # about 0.85 and 0.5
    want = brute_kept(rows)
    assert len(want) == 24
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, frame(spark, rows), sf_dir).collect()) == want


@pytest.mark.parametrize("pair_limit", [64, 3])
def test_classes_are_those_of_brute_force(spark, prose, odd_texts, pair_limit):
    r, rows = random.Random(5), list(enumerate(odd_texts[:-1]))
    for i in range(6):
        base = prose(200, 50 + i)
        for _ in range(25):  # chains and crowds
            base = edited(r, base, r.choice([0, 1, 2, 5, 9])) if r.random() < 0.5 else base
            rows.append((len(rows), edited(r, base, r.choice([0, 1, 3, 4]))))
    kept = N.first_of_each_class(frame(spark, rows).repartition(3), N.CopySettings(pair_limit=pair_limit))
    assert sorted(x.doc_id for x in kept.collect()) == brute_kept(rows)


def test_a_row_goes_only_with_its_own_class(spark, prose):
    a, b = prose(100, 1), prose(100, 2)
    kept = N.first_of_each_class(frame(spark, [(2, a), (2, b), (1, b), (1, b), (None, b), (3, None), (4, " ")]))
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted([(1, b), (2, a), (3, None), (None, b)], key=str)
    assert N.first_of_each_class(frame(spark, [(1, a)]).limit(0)).count() == 0


def test_pairs_at_the_threshold_share_a_band():
    r, s, met = np.random.default_rng(6), N.CopySettings(), 0
    for _ in range(400):
        x = r.integers(0, 1 << 64, 90, np.uint64)
        a, b = np.unique(x[:81]), np.unique(x[9:])  # 72 of 90 runs shared: 0.8
        met += bool(set(N.band_keys(a, s)) & set(N.band_keys(b, s)))
    assert met >= 399
