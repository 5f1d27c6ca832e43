"""Language identification: held-out accuracy, und, and training that sees no held-out row."""

import zlib

from valuemesh.llm import langid


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    small = docs.select("doc_id", "text", "lang", "source")
    truth = {r.doc_id: r.lang for r in small.select("doc_id", "lang").collect()}
    got = langid.op3_langid(small).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es", "und"} for r in got)
    late = [r for r in got if r.held_out]
    right = sum(truth[r.doc_id] == r.lang_pred for r in late) / len(late)
    print("held-out accuracy", right)
    assert right > 0.97


def test_odd_rows(spark):
    rows = [(1, "the thing", "en"), (2, "der die das", "de"), (3, None, "en"), (4, "", None), (5, "12 !!", "de"), (6, "x" * 300_000, None), (6, "é", None), (None, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.op3_langid(docs).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und") == (r.doc_id in (3, 4, 5)) for r in got)
    assert langid.op3_langid(docs.limit(0)).count() == 0
    assert {r.doc_id for r in langid.drop_unidentified(docs, 0.0).collect()} == {1, 2, 6, None}
    assert langid.drop_unidentified(docs).columns == docs.columns


def test_document_frequencies_cover_all_that_is_not_held_out(spark, monkeypatch):
    import numpy as np

    rows = [(i, f"text {'abcdefghij'[i % 10] * 3} {'é' * (i % 3)}" if i % 7 else "12", "en" if i % 2 else None) for i in range(1500)] + [(2000, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    want, texts = np.zeros(langid.BUCKETS), 0
    for d, t, _ in rows:
        if zlib.crc32(str(d).encode()) % 4 != 2 and (got := langid.grams(*langid.normalise([t or ""]))) and sum(len(b) for b, _ in got):
            want[np.unique(np.concatenate([b for b, _ in got]))] += 1
            texts += 1
    given = []
    plain = langid.train
    monkeypatch.setattr(langid, "train", lambda *a, **k: given.append(k["frequencies"]) or plain(*a, **k))
    langid.fit(docs)
    assert given[0][0] == texts and np.array_equal(given[0][1], want)
