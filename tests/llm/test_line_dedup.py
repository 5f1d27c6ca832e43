"""Line dedup against all pairs of lines; the band distance against the full table."""

import random

from valuemesh.llm import line_dedup


def full(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, k, letters="abé"):
    for _ in range(k):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice(letters) + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i + 1 :]])
    return s


def test_band_distance():
    rng = random.Random(1)
    for _ in range(6000):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 14)))
        b = edited(rng, a, rng.randrange(0, 6))
        for most in (0, 1, 2, 3):
            assert min(line_dedup.band_distance(a, b, most), most + 1) == min(full(a, b), most + 1), (a, b, most)


def brute(rows):
    lines = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x and not x.isspace()]
    texts = sorted({x for _, _, x in lines})
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if min(len(a), len(b)) >= line_dedup.LEAST and abs(len(a) - len(b)) <= 2 and full(a, b) <= 2:
                root[find(b)] = find(a)
    first, gone = {}, {}
    for d, i, x in sorted(lines, key=lambda r: r[:2]):
        if find(x) in first:
            gone.setdefault(d, []).append(i)
        first.setdefault(find(x), (d, i))
    return gone, {d: sum(r[0] == d for r in lines) for d, _ in rows}


def make(rng, n):
    bases = ["".join(rng.choice("abcdefé 01") for _ in range(rng.randrange(5, 70))) for _ in range(30)]
    rows = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "short\nshort\nshorT")]
    for d in range(n):
        rows.append((d, "\n".join(edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 3])) if rng.random() < 0.8 else "".join(rng.choice("xyz") for _ in range(40)) for _ in range(rng.randrange(1, 6)))))
    return rows


def test_removed_lines_equal_brute_force(spark):
    rows = make(random.Random(2), 120)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, line string")
    gone, count = brute(rows)
    got = line_dedup.op4_line_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.removed, r.n_removed) == (count[r.doc_id], sorted(gone.get(r.doc_id, [])), len(gone.get(r.doc_id, []))), r
    kept = line_dedup.drop_duplicate_lines(docs)
    assert kept.columns == docs.columns
    texts = dict(rows)
    want = {}
    for d, t in rows:
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, [])) if t is not None else None
        if d not in gone or left.strip():
            want[d] = left
    assert {r.doc_id: r.text for r in kept.collect()} == want and texts
    assert line_dedup.op4_line_dedup(docs.limit(0)).count() == 0


def test_driver_documents(spark):
    import itertools

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    seen = {}
    for d, t in sorted(rows):
        for i, x in enumerate(t.split("\n")):
            seen.setdefault(x, []).append((d, i))
    got = {r.doc_id: r.removed for r in line_dedup.op4_line_dedup(docs).collect()}
    exact = {(d, i) for v in seen.values() for d, i in v[1:] if v}
    have = {(d, i) for d, places in got.items() for i in places}
    assert {e for e in exact if not dict(rows)[e[0]].split("\n")[e[1]].isspace() and dict(rows)[e[0]].split("\n")[e[1]]} <= have
    assert list(itertools.islice(have, 1))


def test_sketch_never_rules_out_near_lines():
    import numpy as np

    rng = random.Random(7)
    for _ in range(500):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 90)))
        b = edited(rng, a, rng.randrange(0, 3))
        x = line_dedup.sketches([a, b])
        assert line_dedup._near(x, np.array([len(a), len(b)]), 0, np.array([1]))[0]
