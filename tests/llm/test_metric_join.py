"""Vector join against all pairs in double precision."""

import math

import numpy as np

from valuemesh.llm import metric_join


def brute(rows, c=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ok):
        for j in ok[n + 1 :]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= c:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, links[i], least[find(i)], k == least[find(i)]) for i, (k, _) in enumerate(rows))


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BLOCK", 24)
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for _ in range(25):
        c = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 14))):
            rows.append((n, (c + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.3])).astype(np.float32).tolist()))
            n += 1
    rows += [(n + i, rows[0][1]) for i in range(40)]
    n += 40
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 8), (n + 3, [1.0, None] + [0.0] * 6), (n + 4, [float("nan")] * 8), (n + 5, [float("inf")] * 8), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [-0.0, 1.0])]
    table = spark.createDataFrame([(i, v, 3, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, size int")
    got = sorted(tuple(r) for r in metric_join.op8_embedding_join(table).collect())
    assert got == brute(rows)
    assert metric_join.op8_embedding_join(table.limit(0)).count() == 0


def test_driver_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    assert sorted(tuple(r) for r in metric_join.op8_embedding_join(table).collect()) == brute(rows)
