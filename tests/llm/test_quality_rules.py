import collections
import math
import random
import re

from quillon.llm import quality_rules as R

from .conftest import frame


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {p for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_base_counts(spark, odd_texts, prose):
    r = random.Random(2)
    texts = [*odd_texts, "a a a a", "a b c a b c", "x\nx\n \n \nx ", "# a <b> | $ ** &", "\n\n", "a b c d\n" * 40]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(1, 40))) for _ in range(60)]
    got = R.judge_documents(frame(spark, list(enumerate(texts)) + [(0, None)]), [0.0] * 10).collect()
    assert len(got) == len(texts) + 1
    for g in got:
        want = brute_counts(texts[g.doc_id])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, texts[g.doc_id]
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and g.kept == (not g.base_failed)


def test_ratios_and_scores(spark, prose):
    texts = {i: prose(80, i) for i in range(30)} | {i: "junk*** more$$$ " * 40 + prose(60, i) for i in range(30, 40)}
    docs = frame(spark, [*texts.items(), (None, "never trusted"), (50, None)])
    trusted = spark.createDataFrame([(i,) for i in range(20)] + [(None,), (3,), (777,)], "doc_id bigint")
    s = R.RatioSettings(buckets=500)
    ratios = R.log_ratios(docs, trusted, s)
    assert ratios == R.log_ratios(docs.repartition(7), trusted, R.RatioSettings(buckets=500, broadcast_bytes=1))
    buckets = {r.doc_id: r.b for r in docs.select("doc_id", R.ngram_buckets(R.words_of(docs.text), 500).alias("b")).collect()}
    raw, target = collections.Counter(), collections.Counter()
    for i, b in buckets.items():
        raw.update(b)
        if i is not None and i < 20:
            target.update(b)
    share = sum(target.values()) / sum(raw.values())
    want = [math.log((target[b] + 5) / (share * raw[b] + 5)) for b in range(500)]
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(ratios, want, strict=True))
    for g in R.judge_documents(docs, ratios, s).collect():
        b = buckets[g.doc_id]
        assert math.isclose(g.score, sum(ratios[x] for x in b) / len(b) if b else 0, abs_tol=1e-9)
        assert g.kept == (not g.base_failed and g.score >= s.threshold)
    assert all(len(buckets[i]) == 2 * len(texts[i].split()) - 1 for i in range(30))


def test_empty_tables(spark):
    docs = frame(spark, [(1, "a b")])
    assert R.log_ratios(docs.limit(0), docs.select("doc_id")) == [0.0] * 10_000
    assert R.judge_documents(docs.limit(0), [0.0]).count() == 0
    assert set(R.log_ratios(docs, docs.select("doc_id").limit(0))) == {0.0}
