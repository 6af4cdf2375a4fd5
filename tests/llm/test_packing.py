import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.errors import PythonException

from quillon.llm import packing as P

from .conftest import frame

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["İstanbul ǅ ﬁ é a\u0301b \u0301x <|endoftext|>a b<|startoftext|> x\u00a0y \x1c z\x85q it's we'll 12345 ½ 中文 😀👍🏽 \ufeffbom ẞß ΑΣ. \u200bzero\u200d", "\u0340\u0345 가각 가"]


def listed(tokenizer, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in tokenizer.ids(None if t is None else t.encode() for t in texts)]


def plainly(texts):
    t = P.WordTokenizer(PATH).tokenizer
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


MARKED = ["Don't. IT'S!!! 'tis (a) b) x's' 12. 3,4; é. é!! ½. a_b__ <| A<|endoftext|>. <|ENDOFTEXT|> B.", "ab.\u0338 cd=\u0338 Ab\u0301. K\u212a. a.b. .. . 'll. Z'll' " + "long" * 40 + "."]


@pytest.mark.parametrize("chunk", [1, 30, 2 << 20])
def test_ids_are_the_tokenizers(monkeypatch, odd_texts, chunk):
    monkeypatch.setattr(P, "PART_BYTES", chunk)
    texts = [*(odd_texts if chunk > 100 else odd_texts[:-1]), *ODD, *MARKED, *[x.replace("<|", "") for x in ODD + MARKED], None, "", "end", "x" * 100_000, ""]
    t = P.WordTokenizer(PATH)
    assert listed(t, texts) == plainly(texts)
    assert listed(t, texts[::-1]) == plainly(texts[::-1])  # from memory
    assert listed(t, []) == [] and listed(t, [None, ""]) == [[], []]


def test_any_marks_and_cases():
    r = random.Random(3)
    texts = ["".join(r.choice("aBc1éßÿ÷É'’.,!?<|>-_ \n\t\u00a0\u0301s") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    assert listed(P.WordTokenizer(PATH), texts) == plainly(texts)


def test_small_memory_changes_nothing(monkeypatch, prose):
    texts = [prose(50, i) for i in range(20)] * 2 + ["w" * 70] * 3
    monkeypatch.setattr(P, "KEPT_WORDS", 5)
    t = P.WordTokenizer(PATH)
    assert [listed(t, [x])[0] for x in texts] == plainly(texts) and len(t) + len(t.old) <= 200


class Counted:
    """A tokenizer or a model that counts the texts which it is given one by one."""

    def __init__(self, whole, calls):
        self.whole, self.calls = whole, calls

    def encode(self, text, **options):
        self.calls.append(text)
        return self.whole.encode(text, **options)

    def tokenize(self, text):
        self.calls.append(text)
        return self.whole.tokenize(text)


def test_unknown_words_are_tokenised_together(prose):
    texts = [f"{prose(300, i)}, ÉTÉ. Ça{prose(1, i)}é... {prose(300, i + 50)}!" for i in range(30)]
    t, calls = P.WordTokenizer(PATH), []
    t.model, t.tokenizer = Counted(t.tokenizer.model, calls), Counted(t.tokenizer, calls)
    assert listed(t, texts) == plainly(texts) and len(set(" ".join(texts).split())) > 10_000
    assert len(calls) <= 10  # marks; one for each word before


def test_groups_with_special_tokens(monkeypatch, prose):
    texts = [None, "", "A.", "'s a's", "<|endoftext|>A. B.", ".a", "<|b", "É,", "'s.é's", prose(40, 1), "c<|ENDOFTEXT|>.", "", "ﬁ. K, é́. x́,"]
    for bytes_ in (5, 20, 1 << 20):
        monkeypatch.setattr(P, "PART_BYTES", bytes_)
        t = P.WordTokenizer(PATH)
        for seed in range(20):
            some = random.Random(seed).choices(texts, k=30)
            assert listed(t, some) == plainly(some)


def test_memory_is_bounded_within_a_group(monkeypatch, prose):
    monkeypatch.setattr(P, "KEPT_WORDS", 50)
    t, text = P.WordTokenizer(PATH), prose(2000, 1)
    assert listed(t, [text, text]) == plainly([text, text]) and len(t) <= 50 and len(t.old) <= 50


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(score):
    r = np.random.default_rng(0)
    lengths = np.sort(r.integers(1, 101, 900))[::-1]
    s = P.PackSettings(tokens=100, documents=4, attention=6000, score=score)
    bins, offsets = P.best_fit(lengths, s)
    for b in np.unique(bins):
        mine = np.flatnonzero(bins == b)
        n = lengths[mine]
        assert n.sum() <= 100 and len(n) <= 4 and ((n**2).sum() <= 6000 or len(n) == 1)
        order = np.argsort(offsets[mine])
        assert (offsets[mine][order] == np.r_[0, np.cumsum(n[order])[:-1]]).all()
    assert sorted(np.unique(bins)) == list(range(bins.max() + 1))


def plain_best_fit(lengths, s):
    """The rule, piece by piece and sequence by sequence."""
    capacity, free, bins = (s.tokens, s.documents, s.attention), [], []
    for n in lengths:
        need = [x / c for x, c in zip((float(n), 1.0, float(n) ** 2), capacity, strict=True)]
        best = None
        for k, room in enumerate(free):
            if all(r >= x - 1e-12 for r, x in zip(room, need, strict=True)):
                parts = [r * x if s.score == "dot" else (r - x) ** 2 for r, x in zip(room, need, strict=True)]
                score = s.weights[0] * parts[0] + s.weights[1] * parts[1] + s.weights[2] * parts[2]
                if best is None or score < best[0]:
                    best = (score, k)
        if best is None:
            free.append([1.0, 1.0, 1.0])
            best = (0, len(free) - 1)
        free[best[1]] = [r - x for r, x in zip(free[best[1]], need, strict=True)]
        bins.append(best[1])
    return bins


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, 4, 6000), (100, 100, 10_000), (64, 3, 64 * 64)])
def test_best_fit_is_the_plain_rule(score, limits):
    r = np.random.default_rng(3)
    s = P.PackSettings(*limits, weights=(1.0, 0.5, 0.25), score=score)
    for lengths in (r.integers(1, 60, 300), r.choice([1, 20, 32, 50], 200), np.full(40, 30)):  # the last two are ties
        lengths = np.sort(lengths)[::-1]
        assert P.best_fit(lengths, s)[0].tolist() == plain_best_fit(lengths, s)


def test_all_three_capacities_have_a_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lengths = np.sort([r.length for r in P.pieces(docs, PATH).select("length").collect()])[::-1]
    whole, tokens_alone = (P.best_fit(lengths, P.PackSettings(weights=w))[0] for w in (P.PackSettings().weights, (1.0, 0.0, 0.0)))
    assert (whole != tokens_alone).any() and whole.max() <= tokens_alone.max()


def test_close_to_the_bound():
    lengths = np.sort(np.random.default_rng(1).integers(1, 2049, 5000))[::-1]
    bins, _ = P.best_fit(lengths, P.PackSettings())
    assert bins.max() + 1 <= 1.02 * lengths.sum() / 2048 + 1


def test_documents(spark, odd_texts, prose):
    rows = list(enumerate([*odd_texts, *ODD])) + [(50 + i, prose(60, i)) for i in range(40)] + [(None, "none"), (50, prose(60, 0))]
    s = P.PackSettings(pieces_per_task=30)
    got = P.pack_documents(frame(spark, rows).repartition(3), PATH, s, keep_ids=True).collect()
    tokens = plainly([t for _, t in rows])
    want = []
    for (i, _), ids in zip(rows, tokens, strict=True):
        whole = np.array([*ids, 0], "<u4")
        want += [(i, k, a, len(whole[a : a + 2048]), zlib.crc32(whole[a : a + 2048].tobytes()), whole[a : a + 2048].tobytes()) for k, a in enumerate(range(0, len(whole), 2048))]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= 2048
    assert P.pack_documents(frame(spark, rows).limit(0), PATH).count() == 0


def test_too_long_a_piece(spark):
    with pytest.raises(PythonException):
        P.pack(spark.createDataFrame([(1, 3000, 5)], "doc_id int, length bigint, offset int")).collect()
