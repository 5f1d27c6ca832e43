"""Benchmark decontamination (native): a hash set of benchmark n-grams over training windows.

Benchmark windows are few, so their 64-bit hashes ship with the plan as a hash set, behind a check of
their number (SET_LIMIT); beyond it, training windows are joined with them by hash instead, with the same result. Either
way a hit is verified by its words. Training rows never leave their partition but for the rows' own
counts and their verified hits.

Nulls have no words. Items without words have no windows. An empty benchmark leaves all clean.
Repeated rows are answered each on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuemesh.llm.store import Scratch

N = 13
SET_LIMIT = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of maximal runs of digits, letters a-z (A-Z lowered) and all non-ASCII characters."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() would also change letters beyond ASCII; translate() is exact there, but slower
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, GAP), "")


def _grams(ws: Column, n: Column) -> Column:
    """array<struct<len,gram>>: windows of N words, or the whole of fewer (none of no words)."""
    size = F.least(F.lit(N), n)
    at = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - N + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(size.alias("len"), F.array_join(F.slice(ws, i, size), " ").alias("gram")))


def benchmark_windows(bench: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(len, gram, items): each distinct window and the sorted distinct items that hold it."""
    ws = bench.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("ws"))
    rows = ws.select("item", F.explode(_grams(F.col("ws"), F.size("ws"))).alias("g")).select("item", "g.len", "g.gram")
    return rows.groupBy("len", "gram").agg(F.collect_set("item").alias("items"))


def _hash(ws_hashes: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.slice(ws_hashes, at, n))


def _gram_hash(gram: Column) -> Column:
    """The same hash from a window's text: of the array of its words' hashes."""
    return F.xxhash64(F.transform(F.split(gram, " "), lambda w: F.xxhash64(w)))


def _found(at: Column, n: int, hashes: list[int]) -> Column:
    hit = F.filter(at, lambda i: _hash(F.col("wh"), i, n).isin(hashes))
    return F.transform(hit, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len")))


def _windows(at: Column, n: int) -> Column:
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), _hash(F.col("wh"), i, n).alias("h")))


def find_contamination(docs: DataFrame, bench: DataFrame, keys: list[str], text: str = "text", set_limit: int = SET_LIMIT) -> DataFrame:
    """One row per row of ``docs``: ``keys``, n_words, n_hit, items (sorted distinct item ids as strings)."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keys)], F.monotonically_increasing_id().alias("__row"), words(F.col(text)).alias("ws"))
    carried = ["__row", *[f"__k{i}" for i in range(len(keys))]]
    rows = rows.withColumn("n", F.size("ws"))
    grams = benchmark_windows(bench).withColumn("h", _gram_hash(F.col("gram")))
    hashes = grams.select("len", "h").distinct().limit(set_limit + 1).collect()
    hashed = rows.withColumn("wh", F.transform("ws", lambda w: F.xxhash64(w)))
    at = lambda n: F.when(F.col("n") >= n, F.sequence(F.lit(1), F.col("n") - (n - 1))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<struct<pos:int,len:int>>")
    if len(hashes) <= set_limit:
        by_len: dict[int, list[int]] = {}
        for r in hashes:
            by_len.setdefault(r["len"], []).append(r["h"])
        found = [_found(at(n), n, hs) for n, hs in sorted(by_len.items())]
        hits = hashed.withColumn("hits", F.concat(*found) if found else none)
    else:  # too many to ship with the plan: join the windows by their hashes
        # the rows' numbers are used twice, and must be the same both times: written once
        rows = Scratch(docs.sparkSession).write(rows)
        hashed = rows.withColumn("wh", F.transform("ws", lambda w: F.xxhash64(w)))
        lens = [r[0] for r in grams.select("len").distinct().collect()]  # N values at most
        each = F.concat(*[_windows(at(n), n) for n in lens])
        windows = hashed.select("__row", F.explode(each).alias("w")).select("__row", "w.*")
        per_row = windows.join(grams.select("len", "h").distinct(), ["len", "h"], "left_semi").groupBy("__row").agg(F.collect_list(F.struct("pos", "len")).alias("hits"))
        hits = rows.join(per_row, "__row", "left").withColumn("hits", F.coalesce("hits", none))
    gram = lambda x: F.array_join(F.slice(F.col("ws"), x["pos"], x["len"]), " ")
    hits = hits.select(*carried, "n", F.transform("hits", lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len"), gram(x).alias("gram"))).alias("hits"))
    # Verified by the words themselves. A row without hits gets a key of its own, so that such rows
    # do not meet in one partition.
    one = hits.select(*carried, "n", F.explode_outer("hits").alias("x")).select(*carried, "n", "x.pos", "x.len", F.coalesce(F.col("x.gram"), F.concat(F.lit(" "), F.col("__row"))).alias("gram"))
    true = one.join(grams.select("gram", F.col("len").alias("glen"), "items"), "gram", "left")
    spans = F.collect_set(F.when(F.col("items").isNotNull(), F.struct("pos", "len")))
    out = true.groupBy(*carried).agg(F.first("n").cast("long").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keys)], "n_words", _cover(F.col("spans")).alias("n_hit"), "items")


def _cover(spans: Column) -> Column:
    """Words inside any of the spans."""

    def step(acc: Column, x: Column) -> Column:
        end = x["pos"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["pos"]))).alias("n"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"].cast("long"))


def contaminated() -> Column:
    """The rule: some hit, and hits make at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def op7_decontam(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    got = find_contamination(docs, bench, ["doc_id"])
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows. The verdict depends on the text alone, so rows are
    taken out by id and the text's hash."""
    mark = lambda text: F.xxhash64(F.coalesce(text, F.lit("")))
    keyed = docs.select("doc_id", "text", mark(F.col("text")).alias("__mark"))
    bad = find_contamination(keyed, bench, ["doc_id", "__mark"]).where(contaminated()).select(F.col("doc_id").alias("__bad_id"), F.col("__mark").alias("__bad_mark")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (mark(F.col("text")) == F.col("__bad_mark")), "left_anti")
