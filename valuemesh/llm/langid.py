"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased text in which everything but letters became one
space; a text's weights are relative frequency times inverse document frequency, counted over all texts
that are not held out. Training is
follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled rows
(PER_LABEL rows a label and SAMPLE_CHARS characters in all; documented parameters: of more labels each
gets fewer characters, none is left out), a fifth of which is held back to fit the softmax temperature. Prediction covers every whole text: one pass, no shuffle; the
model (BUCKETS x labels floats, at most 64 MB) goes with the task.

A null text, or one without a letter, is ``und`` with score 0. Repeated rows are answered each on
their own. With no labelled rows at all, everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
PER_LABEL, SAMPLE_CHARS = 400, 64_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-6, 1e-6
#: Feature values sum to about SCALE times the mean inverse document frequency.
SCALE = 4.0
#: Characters to a training fragment: parts of sample texts teach how short texts look.
FRAGMENT = 200
CHUNK = 1 << 19
UND = "und"
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets): lower-cased letters with one space before each run of them."""
    joined = "".join("\n" + t for t in texts)  # the separator is its text's own, for its first run
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    letter = _letters()[codes] if len(codes) else np.zeros(0, bool)
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # the character before a run stands for its space
    out = np.where(letter, codes, 32).astype(np.uint32)
    kept = np.concatenate([[0], np.cumsum(keep)])
    offsets = np.concatenate([kept[begin], [kept[-1]]]) if len(texts) else np.zeros(1, np.int64)
    return out[keep], offsets


def grams(codes: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n of 1 to 3: (bucket, text number) of the n-grams that lie within a text."""
    out = []
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    a = codes * np.uint32(0x9E3779B1)
    b = codes * np.uint32(0x85EBCA77)
    c = codes * np.uint32(0xC2B2AE3D)
    for n, h in ((1, a + np.uint32(1)), (2, a[:-1] + (b[1:] ^ np.uint32(0x27D4EB2F))), (3, a[:-2] + (b[1:-1] ^ (c[2:] + np.uint32(0x165667B1))))):
        if len(codes) < n:
            continue
        inside = doc[: len(doc) - n + 1] == doc[n - 1 :]
        h = h ^ (h >> np.uint32(15))
        h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        out.append((h[inside] & np.uint32(BUCKETS - 1), doc[: len(doc) - n + 1][inside]))
    return out


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.labels, self.weights, self.bias, self.temperature = labels, weights, bias, temperature

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text x label logits, whether a text has a letter). ``weights`` already hold the idf."""
        codes, offsets = normalise(texts)
        n = len(texts)
        some = np.diff(offsets) > 0
        total, count = np.zeros((n, len(self.labels))), np.zeros(n)
        for bucket, doc in grams(codes, offsets):
            if not len(doc):
                continue
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            total[doc[first]] += np.add.reduceat(self.weights[bucket], first, axis=0)
            count += np.bincount(doc, minlength=n)
        return total * (SCALE / np.maximum(count, 1))[:, None] + self.bias, some

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        z, some = self.logits(texts)
        if not self.labels:
            return [UND] * len(texts), np.zeros(len(texts))
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        return [self.labels[b] if ok else UND for b, ok in zip(best, some)], np.where(some, p.max(axis=1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7, frequencies: tuple[int, np.ndarray] | None = None) -> Model:
    """Fits weights and temperature on the given sample; ``frequencies`` (texts, and of each bucket the
    texts that hold it) are of the whole corpus, else of the sample."""
    labels = sorted(set(langs))
    number = {v: i for i, v in enumerate(labels)}
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 0.2
    samples = []  # (buckets, frequencies, label)
    for t, lang, out in zip(texts, langs, held):
        if out:
            continue
        at = int(rng.integers(0, max(1, len(t) - FRAGMENT)))
        for part in (t, t[at : at + FRAGMENT], t[at : at + FRAGMENT // 5]):
            got = grams(*normalise([part]))
            if got and sum(len(b) for b, _ in got):
                bucket, n = np.unique(np.concatenate([b for b, _ in got]), return_counts=True)
                samples.append((bucket, n / n.sum(), number[lang]))
    total, seen = (len(samples), np.zeros(BUCKETS)) if frequencies is None else frequencies
    for bucket, _, _ in samples if frequencies is None else ():
        seen[bucket] += 1
    idf = np.log((1 + total) / (1 + seen)) + 1
    k = len(labels)
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    for _ in range(EPOCHS if k > 1 else 0):
        for i in rng.permutation(len(samples)):
            bucket, tf, label = samples[i]
            x = SCALE * tf * idf[bucket]
            w, bias = solved(z[bucket], n[bucket]), solved(zb, nb)
            p = softmax((x @ w + bias)[None])[0]
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[bucket] + g * g) - np.sqrt(n[bucket])) / ALPHA
            z[bucket] += g - sigma * w
            n[bucket] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * bias
            nb += p * p
    model = Model(labels, (solved(z, n) * idf[:, None]).astype(np.float32), solved(zb, nb), 1.0)
    late = [(t, number[v]) for t, v, out in zip(texts, langs, held) if out]
    if k > 1 and late:
        logits, some = model.logits([t for t, _ in late])
        truth = np.array([y for _, y in late])
        nll = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12))[some].mean()
        if some.any():
            model.temperature = float(min(np.geomspace(0.05, 20, 121), key=nll))
    return model


def sample(docs: DataFrame, usable: Column) -> tuple[list[str], list[str]]:
    """Labelled texts for training: of each label the PER_LABEL rows of least hash, of a longer text a part
    of it, such that all labels' parts have SAMPLE_CHARS characters at most."""
    got = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = F.xxhash64("doc_id", F.lit("sample")).bitwiseAND(0xFFFFFF) / float(0x1000000)
    counts = got.groupBy("lang").agg((2 * PER_LABEL / F.count(F.lit(1))).alias("most"))
    labels = counts.count()
    least = got.join(counts, "lang").where(share < F.col("most"))  # some more than are wanted, before rows meet
    first = Window.partitionBy("lang").orderBy(share, "doc_id")
    rows = least.withColumn("__no", F.row_number().over(first)).where(F.col("__no") <= PER_LABEL)
    chars = SAMPLE_CHARS // (PER_LABEL * max(1, labels))
    begin = (F.xxhash64("doc_id", F.lit("part")).bitwiseAND(0xFFFFFF) / float(0x1000000) * F.greatest(F.lit(0), F.length("text") - chars)).cast("int") + 1
    rows = rows.select(F.col("text").substr(begin, F.lit(chars)).alias("text"), "lang", share.alias("share"), "doc_id").orderBy("share", "doc_id").select("text", "lang").collect()
    return [r.text for r in rows], [r.lang for r in rows]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequencies(docs: DataFrame, usable: Column) -> tuple[int, np.ndarray]:
    """(texts with a letter, of each bucket the texts that hold one of its n-grams) over all usable rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from valuemesh.llm.batches import text_chunks

        seen = np.zeros(BUCKETS + 1, np.int64)  # the last is the number of texts
        for rows, _, _ in text_chunks(batches, size=CHUNK):
            codes, offsets = normalise(pc.fill_null(rows.column(0), "").to_pylist())
            seen[BUCKETS] += int((np.diff(offsets) > 0).sum())
            held = [doc.astype(np.int64) * BUCKETS + bucket for bucket, doc in grams(codes, offsets) if len(doc)]
            if held:
                seen[:BUCKETS] += np.bincount(np.unique(np.concatenate(held)) % BUCKETS, minlength=BUCKETS)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["bucket", "n"])

    counted = docs.where(usable).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(BUCKETS + 1)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return int(out[BUCKETS]), out[:BUCKETS]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from valuemesh.llm.batches import text_chunks

        for rows, _, _ in text_chunks(batches, size=CHUNK):
            texts = pc.fill_null(rows.column(1), "").to_pylist()
            lang, score = model.predict(texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, SCHEMA)


def fit(docs: DataFrame) -> Model:
    """A model from the rows that are not held out."""
    usable = ~held_out(F.col("doc_id"))
    return train(*sample(docs, usable), frequencies=document_frequencies(docs, usable))


def op3_langid(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))


def drop_unidentified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without rows that have no letters or whose calibrated score is below ``least``.

    The verdict depends on the text alone; all columns of the input are kept.
    """
    model = fit(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from valuemesh.llm.batches import text_chunks

        for rows, _, _ in text_chunks(batches, size=CHUNK):
            column = rows.column(rows.schema.get_field_index("text"))
            lang, score = model.predict(pc.fill_null(column, "").to_pylist())
            yield rows.filter(pa.array([v != UND and s >= least for v, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
