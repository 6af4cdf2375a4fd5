import hashlib
import random
import re

from quillon.llm import decontaminate as D

from .conftest import frame


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, size=10):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            runs = [v[k : k + size] for k in range(len(v) - size + 1)] if len(v) >= size else [v] if v else []
            for run in runs:
                for k in range(len(w) - len(run) + 1):
                    if w[k : k + len(run)] == run:
                        hit |= set(range(k, k + len(run)))
                        found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, doc_id int, term string")


def test_against_brute_force(spark, odd_texts):
    r = random.Random(11)
    pick = lambda n: " ".join(r.choice(["the", "of", "a", "Zeta", "éa", "x1", "rare%d" % r.randrange(9)]) for _ in range(n))
    items = [(i, pick(r.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(25)] + [(90, None), (91, "..."), (92, "same same same same same same same same same same same"), (93, items_text := pick(30)), (94, items_text)]
    docs = [(i, t) for i, t in enumerate(odd_texts[:6])]
    for i in range(10, 60):
        a = items[r.randrange(len(items))][1] or ""
        docs.append((i, pick(r.randrange(30)) + " " + a.upper().replace(" ", ",\n") + "! " + pick(r.randrange(30)) + " " + a))
    docs.append((70, "same " * 40))
    got = D.digests(D.contamination(frame(spark, docs).repartition(3), items_frame(spark, items))).collect()
    want = brute(docs, items)
    assert len(got) == len(docs)
    for g in got:
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == want[g.doc_id], g.doc_id
    far = D.DecontaminationSettings(broadcast_bytes=0)
    assert sorted(map(tuple, D.digests(D.contamination(frame(spark, docs), items_frame(spark, items), far)).collect())) == sorted(map(tuple, got))
    assert sorted(r[0] for r in D.contaminated_ids(frame(spark, docs), items_frame(spark, items)).collect()) == sorted(i for i in want if want[i][1])


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(12))
    docs = [(1, text), (1, text), (None, "x " + text), (2, "w0 w1")]
    got = {}
    for g in D.contamination(frame(spark, docs), items_frame(spark, [(5, text)])).collect():
        got.setdefault(g.doc_id, []).append((g.n_words, g.n_hit, g["items"]))
    assert got == {1: [(12, 12, ["5"])] * 2, None: [(13, 12, ["5"])], 2: [(2, 0, [])]}


def test_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b c")]), items_frame(spark, [(1, "a b c")])
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.digests(D.contamination(docs, items.limit(0))).first().items_sha256 == hashlib.sha256(b"").hexdigest()


def test_long_text(spark, prose):
    text = prose(40_000, 3)
    item = " ".join(text.split()[39_000:39_030])
    g = D.contamination(frame(spark, [(1, text)]), items_frame(spark, [(1, item)])).first()
    assert g.n_words == 40_000 and g.n_hit >= 30


def test_proximity(spark):
    items = items_frame(spark, [(1, "red green blue")])
    docs = [(1, "blue x red y green"), (2, "red " + "z " * 20 + "green blue"), (3, "green red"), (4, "q " * 200 + "green red q blue")]
    w, _, terms = D.item_windows(items, 10)
    index = D.build_index(frame(spark, docs), terms)
    assert sorted({r.doc_id for r in D.proximity_matches(index, w, terms, slack=3).collect()}) == [1, 4]
    whole = D.build_index(frame(spark, docs))
    assert whole.filter("term_id = 'z'").count() == 20
