"""Jaccard join against all pairs, on hand-made groups and the driver's documents."""

import random
import re

from pyspark.sql import functions as F

from valuemesh.llm import blocks, jaccard_join


def shingle_set(t):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for members in by.values():
        for i in members:
            for j in members:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * len(sets[i] | sets[j]):
                        root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)}


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, cls string")
    got = jaccard_join.op9_ngram_jaccard(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)


def mutated(rng, w, k):
    w = list(w)
    for _ in range(k):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], ["new%d" % rng.randrange(10**6)], [w[i], "ins%d" % rng.randrange(10**6)]])
        w = w or ["x"]
    return w


def test_small_and_odd_sets(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b c d"), (7, "a b c d e"), (8, "A b  c\td e"), (9, "é b c d e"), (10, "É b c d e")]
    n = 100
    for base in range(60):
        w = ["w%d" % rng.randrange(40) for _ in range(rng.randrange(8, 120))]
        for _ in range(rng.randrange(1, 7)):
            n += 1
            rows.append((n, " ".join(mutated(rng, w, rng.randrange(0, 3 + len(w) // 40)))))
    check(spark, rows)


def test_common_passage_and_large_group(spark, monkeypatch):
    """A passage in many otherwise different texts makes long lists, here of many blocks; a large group
    makes long chains."""
    monkeypatch.setattr(blocks, "BLOCK", 7)
    rng = random.Random(2)
    passage = ["p%d" % i for i in range(60)]
    rows = []
    for i in range(80):
        own = ["o%d" % rng.randrange(10**6) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(passage + own)))
    base = ["b%d" % i for i in range(150)]
    for i in range(80):
        base = mutated(rng, base, 1)
        rows.append((1000 + i, " ".join(base)))
    check(spark, rows)


def test_driver_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(spark, rows)


def test_drop_and_empty(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (3, "", "z"), (4, None, "z")], "doc_id long, text string, head string")
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert jaccard_join.op9_ngram_jaccard(docs.limit(0)).count() == 0


def test_sketch_never_rules_out_a_link():
    import numpy as np

    rng = np.random.default_rng(3)
    linked = ruled_out = 0
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        k = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate([a[: len(a) - k], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)]))
        sizes = np.array([len(a), len(b)])
        x, y = (jaccard_join.sketches(v, np.zeros(len(v), int), np.array([len(v)]))[0] for v in (a, b))
        possible = bool(jaccard_join.near(sizes, [x, y])(0, np.array([1]))[0])
        both = len(set(a.tolist()) & set(b.tolist()))
        expected = both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)
        assert jaccard_join.similar(a, b) == expected
        assert possible or not expected
        linked += expected
        ruled_out += not possible
    assert linked > 20 and ruled_out > 20


def test_links_that_the_first_forest_misses(spark, monkeypatch):
    """With sketches that rule nothing out, first edges mostly fail and the last look has to decide."""
    import numpy as np

    monkeypatch.setattr(jaccard_join, "near", lambda n, sketch: lambda i, others: np.ones(len(others), bool))
    rng = random.Random(6)
    passage = ["p%d" % i for i in range(40)]
    rows = [(i, " ".join(passage + mutated(rng, ["q%d" % (i % 5 * 50 + k) for k in range(30)], 2))) for i in range(60)]
    check(spark, rows)
    monkeypatch.setattr(blocks, "BLOCK", 9)
    check(spark, rows)


def test_sets_in_one_segment_stay_in_long_lists(spark):
    """Sets of 8 and 10 shingles, all in one segment of band 0, meet on the keys of its empty segments only."""
    import numpy as np

    rng, rows = random.Random(4), []
    for i in range(40):
        w = ["s%d" % rng.randrange(10**6) for _ in range(4)]
        while len(w) < 14:
            text = " ".join([*w, "s%d" % rng.randrange(10**6)]).encode()
            s, _ = jaccard_join.shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            if int(s.max() >> np.uint64(32)) * 3 >> 32 == 0:
                w = text.decode().split()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:12]))]
    check(spark, rows)


def test_sets_filter_and_hash_in_one_worker(spark):
    """A stage of two Python functions holds two workers a task: the pipeline ran out of an executor's memory there."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g"), (None, "a b c d e f")], "doc_id bigint, text string")
    heads = jaccard_join._rows(docs).where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("head"))
    sets = jaccard_join._sets(docs, heads)
    assert sets._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") - heads._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sets.count() == 2
