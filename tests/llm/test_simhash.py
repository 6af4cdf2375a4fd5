import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import simhash as S

from .conftest import frame


def brute_print(text, k=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, distance=2):
    left, roots = set(prints), {}
    while left:
        todo = {left.pop()}
        found = set()
        while todo:
            a = todo.pop()
            found.add(a)
            near = {b for b in left if (a ^ b).bit_count() <= distance}
            left -= near
            todo |= near
        for f in found:
            roots[f] = min(found)
    return roots


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_golay_code_is_perfect():
    leaders, fours = S.golay_tables()
    assert sorted(np.unique(np.bitwise_count(leaders), return_counts=True)[1].tolist()) == [1, 23, 253, 1771]
    assert ((fours >= 0).all(axis=1) == (np.bitwise_count(leaders) == 3)).all()


def test_words_two_bits_apart_share_an_index():
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 23, 300).astype(np.uint32)
    for i in range(23):
        for j in range(i, 23):
            other = words ^ np.uint32(1 << i) ^ np.uint32(0 if i == j else 1 << j)
            a, b = S.codeword_indices(words), S.codeword_indices(other)
            assert all({*x} - {-1} & {*y} - {-1} for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_keys_meet_for_every_pair_of_bits():
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(3)]
    for x in base:
        others = [x ^ (1 << i) ^ (0 if i == j else 1 << j) for i in range(64) for j in range(i, 64)]
        keys = S.fuzzy_keys(np.array([x, *others], np.uint64))
        assert all(set(keys[0]) & set(k) for k in keys[1:])
        assert len(keys[0]) <= 18


@pytest.mark.parametrize("pair_limit", [64, 2])
def test_components_of_planted_prints(spark, pair_limit):
    r = random.Random(7)
    prints = set()
    for _ in range(60):
        x = r.getrandbits(64)
        prints.add(x)
        for _ in range(r.choice([0, 0, 1, 3, 40])):  # chains and crowds
            x ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            prints.add(x)
    prints |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 1}
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    want = brute_classes(prints)
    links = S.linked_prints(df, S.SimHashSettings(pair_limit=pair_limit))
    got = {p & (1 << 64) - 1: p for p in prints}
    for row in S.components(links).collect():
        got[row.node & (1 << 64) - 1] = row.root & (1 << 64) - 1
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want)


def test_documents(spark, odd_texts, prose):
    base = prose(400, 1)
    near = base.replace(base.split()[200], "zzz", 1)
    texts = [*odd_texts, base, base.upper(), near, base + "\n", prose(50, 2), "b a", "B  a"]
    rows = list(enumerate(texts)) + [(7, base), (None, base)]
    got = S.near_duplicates(frame(spark, rows).repartition(3)).collect()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    roots = brute_classes(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    assert len(got) == len(rows)
    for row in got:
        i = 7 if row.doc_id is None else row.doc_id
        assert row.fp & (1 << 64) - 1 == prints[i] and row.component_id == least[roots[prints[i]]]
    assert S.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    shown = S.near_duplicates(frame(spark, rows[:1])).select(S.hex_print(F.col("fp"))).first()[0]
    assert shown == "0" * 16


def test_first_of_each_class(spark, prose):
    base = prose(300, 9)
    rows = [(4, base), (2, base), (2, base), (9, base.title()), (5, prose(80, 1)), (6, None), (8, ""), (None, base)]
    kept = S.first_of_each_class(frame(spark, rows))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 5, 6, None]
    assert kept.columns == frame(spark, rows).columns


def test_first_of_each_class_judges_rows_not_ids(spark, prose):
    a, b = prose(100, 1), prose(100, 2)
    kept = S.first_of_each_class(frame(spark, [(2, a), (2, b), (1, b)]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, b), (2, a)]
    kept = S.first_of_each_class(frame(spark, [(2, a), (2, b), (2, b)]))
    assert sorted(r.text for r in kept.collect()) == sorted([a, b])
