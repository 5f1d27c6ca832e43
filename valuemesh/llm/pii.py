"""Personal data (native): patterns propose spans, checksums confirm them, context scores them.

Everything is a column expression over one row, so the plan is scan, project: no shuffle, no Python.
Nulls and empty texts have no spans. Repeated rows are answered each on their own. Other columns of
the input are kept, unless they clash with an output name; then the output replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuemesh.llm.spans import apart, find_all, render, tag

#: The first four are the base kinds; the rest are added by the method.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4

# Written so that the Java engine neither recurses nor retries inside a run that already failed; the
# matches are those of the plain forms given beside each.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:\.?+[A-Za-z0-9-])*+",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    # as it is
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Lower-case words which, within CONTEXT_CHARS before a span, raise its score.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto",
    "ssn": "ssn|social security",
}
CONTEXT_CHARS = 40
#: Score of a confirmed span, what context adds, and the least score of an added span.
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
BOOST, LEAST = 0.3, 0.5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; false for other strings' lengths of 0."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97, its first four characters moved last."""
    moved = F.split(F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(moved, F.lit(0), step) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.regexp_like(hit, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        plain = F.regexp_replace(hit, "\\x20", "")
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def _score(kind: str, text: Column, start: Column) -> Column:
    before = F.lower(F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)).cast("int") + 1, F.least(start, F.lit(CONTEXT_CHARS)).cast("int")))
    near = F.regexp_like(before, F.lit(rf"(?<![a-z])(?:{CONTEXT[kind]})"))
    return F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(near, BOOST).otherwise(0.0))


def _kept(kind: str, added: bool) -> Column:
    kept = F.filter(F.col(f"__{kind}"), lambda s: _confirmed(kind, s["hit"]))
    if added:
        kept = F.filter(kept, lambda s: _score(kind, F.col("__t"), s["start"]) >= LEAST)
        for base in KINDS[:BASE]:
            kept = apart(kept, F.col(f"__{base}"))
    return kept


def _scored(kind: str) -> Column:
    return F.transform(F.col(f"__{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), _score(kind, F.col("__t"), s["start"]).alias("score")))


def find_personal(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``: struct of one array of spans per kind, and ``scores`` beside all spans in order.

    Base spans are those of the pattern that their checksum or digit count confirms. Added spans
    also need a score of LEAST, and do not overlap a base span. A null text counts as empty.
    """
    got = docs.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    for kind in KINDS:
        got = got.withColumn(f"__{kind}", find_all(F.col("__t"), PATTERNS[kind]))
    for no, kind in enumerate(KINDS):
        got = got.withColumn(f"__{kind}", tag(_kept(kind, no >= BASE), no))
    scores = F.concat(*[_scored(k) for k in KINDS])
    got = got.withColumn(out, F.struct(*[F.col(f"__{k}").alias(k) for k in KINDS], F.array_sort(scores).alias("scores")))
    return got.drop("__t", *[f"__{k}" for k in KINDS])


def op5_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores for every row."""
    got = find_personal(docs.select("doc_id", "text")).select("doc_id", "pii")
    base = F.concat(*[F.col("pii")[k] for k in KINDS[:BASE]])
    every = F.concat(*[F.col("pii")[k] for k in KINDS])
    return got.select(
        "doc_id",
        *[F.size(F.col("pii")[k]).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(render(base, KINDS), 256).alias("base_sha256"),
        render(every, KINDS).alias("spans"),
        F.array_join(F.transform(F.col("pii")["scores"], lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )
