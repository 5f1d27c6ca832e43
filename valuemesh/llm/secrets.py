"""Secret scan (native): fixed credential patterns and sliding-window entropy per character class.

Column expressions over one row only: scan, project, no shuffle and no Python. Null and empty texts
have no spans; repeated rows are answered each on their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuemesh.functions.numbers import let
from valuemesh.llm.spans import apart, find_all, render, tag

#: The first three are the base kinds; entropy spans are added by the method.
KINDS = ["assign", "access", "hex", "entropy"]
BASE = 3
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Candidate strings of the entropy scan: whole runs of this class, of WINDOW characters or more.
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
#: Per character class: what a candidate must be made of, what it must hold, and the least bits per
#: character of its best window.
CLASSES = {
    "hex": (r"^[0-9A-Fa-f]+$", [r"[0-9]", r"[A-Fa-f]"], 3.0),
    "base64": (r"^[A-Za-z0-9+/_=-]+$", [r"[0-9]", r"[A-Z]", r"[a-z]"], 3.6),
}
#: Candidates that match one of these are not secrets: identifiers, paths, placeholders, rules.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|dummy|xxxx|0123456789|abcdefgh",
    r"^/?(?:[A-Za-z_-]++[0-9]{0,3}/)++[A-Za-z_-]*+[0-9]{0,3}$",
    r"^[A-Za-z0-9]+(?:[_-][A-Za-z]+)+$",
    r"([+/_=-])\1{3}",
]


#: Characters are counted by their place here (all others as one); a count takes BITS of a long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
BITS, IN_ONE = 5, 12


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits per character) of any window of ``s``, by incremental counts.

    The characters become an array once. The counts of the window go along, IN_ONE of them in a long; a step
    adds the entering character and drops the leaving one, and changes the running sum of n*log2(n) by
    these two characters' counts alone, so the work is linear in the length. Strings shorter than the
    window give 0; ``window`` is below 2**BITS.
    """
    table = F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(window + 2)])
    weight = lambda n: F.get(table, n)
    words = -(-(len(ALPHABET) + 1) // IN_ONE)
    place = lambda c: F.position(c, F.lit(ALPHABET))
    chars = F.transform(F.split(s, ""), lambda c: F.struct((place(c) / IN_ONE).cast("int").alias("word"), (place(c) % IN_ONE * BITS).alias("shift")))
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c["shift"])
    count = lambda held, c: F.call_function("shiftright", F.get(held, c["word"]), c["shift"]).bitwiseAND((1 << BITS) - 1).cast("int")

    def largest(cs: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enter, leave = F.get(cs, i - 1), F.get(cs, i - 1 - window)
            full = i > window
            same = full & (leave == enter)
            n_out, n_in = count(acc["held"], leave), count(acc["held"], enter)
            total = acc["sum"] - F.when(full & ~same, weight(n_out) - weight(n_out - 1)).otherwise(0.0)
            total = total + F.when(same, 0.0).otherwise(weight(n_in + 1) - weight(n_in))
            moved = F.transform(acc["held"], lambda v, k: v + F.when(enter["word"] == k, one(enter)).otherwise(0) - F.when(full & (leave["word"] == k), one(leave)).otherwise(0))
            bits = F.when(i >= window, F.lit(math.log2(window)) - total / window).otherwise(0.0)
            return F.struct(total.alias("sum"), F.greatest(acc["best"], bits).alias("best"), moved.alias("held"))

        held = F.array(*[F.lit(0).cast("long")] * words)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), held.alias("held"))
        return F.aggregate(F.sequence(F.lit(1), F.size(cs)), start, step, lambda a: a["best"])

    return F.when(F.length(s) >= window, let(chars, largest)).otherwise(0.0)


def _is_secret(hit: Column) -> Column:
    allowed = F.lit(False)
    for rule in ALLOW:
        allowed = allowed | F.regexp_like(hit, F.lit(rule))
    found = F.lit(False)
    for made, holds, bits in CLASSES.values():
        fits = F.regexp_like(hit, F.lit(made))
        for part in holds:
            fits = fits & F.regexp_like(hit, F.lit(part))
        found = found | F.when(fits & ~allowed, window_entropy(hit) >= bits).otherwise(False)
    return found


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds ``out``: struct of one array of spans per kind. Entropy spans touch no base span."""
    got = docs.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    got = got.withColumn("__assign", F.filter(find_all(F.col("__t"), ASSIGN, 1), lambda s: F.length(s["group"]) >= 8))
    got = got.withColumn("__access", find_all(F.col("__t"), ACCESS)).withColumn("__hex", find_all(F.col("__t"), HEX))
    got = got.withColumn("__entropy", find_all(F.col("__t"), CANDIDATE))
    kept = F.col("__entropy")
    for base in KINDS[:BASE]:
        kept = apart(kept, F.col(f"__{base}"))
    got = got.withColumn("__entropy", F.filter(kept, lambda s: _is_secret(s["hit"])))
    for no, kind in enumerate(KINDS):
        got = got.withColumn(f"__{kind}", tag(F.col(f"__{kind}"), no))
    return got.withColumn(out, F.struct(*[F.col(f"__{k}").alias(k) for k in KINDS])).drop("__t", *[f"__{k}" for k in KINDS])


def op6_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    got = find_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    base = F.concat(*[F.col("secrets")[k] for k in KINDS[:BASE]])
    every = F.concat(*[F.col("secrets")[k] for k in KINDS])
    return got.select(
        "doc_id",
        *[F.size(F.col("secrets")[k]).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(render(base, KINDS), 256).alias("base_sha256"),
        render(every, KINDS).alias("spans"),
    )
