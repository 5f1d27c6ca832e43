"""The same results in DuckDB's SQL, by plain comparison of all rows; ids are distinct in these tables."""

from __future__ import annotations

from valuemesh.llm import decontam, pii, secrets

_LOWERED = f"translate(coalesce(text, ''), '{decontam.UPPER}', '{decontam.LOWER}')"


def _components(node: str, links: str) -> str:
    """CTEs after others: reach(id, other), the nodes that links (a, b) reach from each that has one."""
    return f"ways AS (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}), reach AS (SELECT a AS id, b AS other FROM ways UNION SELECT r.id, b.b FROM reach r JOIN ways b ON b.a = r.other), least AS (SELECT id AS {node}, min(other) AS other FROM reach GROUP BY id)"


def jaccard() -> str:
    return (
        rf"WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents), "
        "s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w), "
        "e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), "
        "p AS (SELECT l.doc_id AS a, r.doc_id AS b FROM e l JOIN e r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY l.doc_id, r.doc_id, l.n, r.n HAVING 100 * count(*) >= 80 * (l.n + r.n - count(*))), "
        f"{_components('doc_id', 'p')} "
        "SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id FROM s LEFT JOIN least USING (doc_id)"
    )


def vectors() -> str:
    return (
        "WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x AS double)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
        "n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size, len(v) AS width FROM v), "
        "p AS (SELECT l.vec_id AS a, r.vec_id AS b FROM n l JOIN n r ON l.vec_id < r.vec_id AND l.width = r.width WHERE list_dot_product(l.v, r.v) / (l.size * r.size) >= 0.9), "
        f"{_components('vec_id', 'p')}, c AS (SELECT a AS vec_id, count(*) AS n FROM ways GROUP BY a) "
        "SELECT vec_id, coalesce(c.n, 0) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(other, vec_id)) AS kept FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN least USING (vec_id)"
    )


def contamination() -> str:
    words = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = lambda size: f"list_transform(range(1, len(w) - {size} + 2), lambda i: {{'pos': i, 'gram': array_to_string(w[i:i + {size} - 1], ' ')}})"
    return (
        f"WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT cast(item_id AS varchar) AS item, {words} AS w FROM benchmark), "
        f"g AS (SELECT DISTINCT item, size, x.gram AS gram FROM (SELECT item, size, unnest({grams('size')}) AS x FROM (SELECT item, w, least(len(w), {decontam.N}) AS size FROM b WHERE len(w) > 0))), "
        f"o AS (SELECT doc_id, size, x.pos AS pos, x.gram AS gram FROM (SELECT doc_id, size, unnest({grams('size')}) AS x FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size)), "
        "h AS (SELECT doc_id, size, pos, item FROM o JOIN g USING (size, gram)), "
        "c AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM (SELECT DISTINCT doc_id, size, pos FROM h)) GROUP BY doc_id), "
        "i AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id) "
        "SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated "
        "FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"
    )


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _spans(name: str, pattern: str, holds: str, group: int = 0) -> str:
    """CTE ``name`` (doc_id, t, hit, part, start, stop) of the matches for which ``holds``."""
    p = _literal(pattern)
    return (
        f"{name} AS (SELECT doc_id, t, hit, part, cast(start AS bigint) AS start, cast(start + length(hit) AS bigint) AS stop FROM (SELECT doc_id, t, unnest(h) AS hit, unnest(parts) AS part, "
        "unnest(list_transform(range(1, len(h) + 1), lambda i: list_sum(gap[1:i]) + coalesce(list_sum(wide[1:i - 1]), 0))) AS start "
        "FROM (SELECT *, list_transform(h, lambda x: length(x)) AS wide FROM "
        f"(SELECT doc_id, t, regexp_extract_all(t, {p}) AS h, regexp_extract_all(t, {p}, {group}) AS parts, list_transform(string_split_regex(t, {p}), lambda g: length(g)) AS gap FROM docs WHERE regexp_matches(t, {p})))) WHERE {holds})"
    )


def _answer(kinds: list[str], base: int, more: str = "") -> str:
    """The digest columns from ``every`` (doc_id, start, stop, no, kind)."""
    shown = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no, stop) FILTER (WHERE {where}), '')"
    counts = ", ".join(f"count(kind) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds[:base])
    return f"SELECT doc_id, {counts}, sha256({shown(f'no < {base}')}) AS base_sha256, {shown('true')} AS spans{more} FROM docs LEFT JOIN every USING (doc_id) GROUP BY doc_id"


def _apart(name: str, others: list[str]) -> str:
    clear = " AND ".join(f"NOT EXISTS (SELECT 1 FROM {o} o WHERE o.doc_id = x.doc_id AND o.start < x.stop AND x.start < o.stop)" for o in others)
    return f"SELECT * FROM {name} x WHERE {clear}"


def personal() -> str:
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    worth = "CASE WHEN i % 2 = 1 THEN cast(n[i] AS int) WHEN cast(n[i] AS int) > 4 THEN 2 * cast(n[i] AS int) - 9 ELSE 2 * cast(n[i] AS int) END"
    luhn = f"list_sum(list_transform([string_split(reverse({digits}), '')], lambda n: list_sum(list_transform(range(1, len(n) + 1), lambda i: {worth})))) % 10 = 0"
    byte = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    plain = "replace(hit, ' ', '')"
    moved = f"list_transform(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    mod97 = f"list_reduce(list_prepend(0, {moved}), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END) = 1"
    before = f"lower(substr(t, cast(greatest(start - {pii.CONTEXT_CHARS}, 0) + 1 AS bigint), cast(least(start, {pii.CONTEXT_CHARS}) AS bigint)))"
    score = lambda k: f"least(1.0, {pii.BASE_SCORE[k]} + CASE WHEN regexp_matches({before}, '(^|[^a-z])({pii.CONTEXT[k]})') THEN {pii.BOOST} ELSE 0.0 END)"
    parts = [
        _spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _spans("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_full_match(hit, '{byte}(\.{byte}){{3}}')"),
        _spans("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        _spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
        # an underscore is no letter here; a date-like number is a whole run of digits and dashes
        _spans("iban_all", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", f"length({plain}) BETWEEN 15 AND 34 AND {mod97}").replace("FROM docs", "FROM (SELECT doc_id, translate(t, '_', '~') AS t FROM docs)"),
        _spans("ssn_all", r"[0-9-]+", f"regexp_full_match(hit, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND {score('ssn')} >= {pii.LEAST}"),
        f"iban AS ({_apart('iban_all', pii.KINDS[: pii.BASE])})",
        f"ssn AS ({_apart('ssn_all', pii.KINDS[: pii.BASE])})",
        "every AS (" + " UNION ALL ".join(f"SELECT doc_id, start, stop, {no} AS no, '{k}' AS kind, {score(k)} AS score FROM {k}" for no, k in enumerate(pii.KINDS)) + ")",
    ]
    scores = ", coalesce(string_agg(printf('%.2f', cast(score AS double)), ',' ORDER BY start, kind), '') AS scores"
    return f"WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(parts)} {_answer(pii.KINDS, pii.BASE, scores)}"


def credentials() -> str:
    allow = [x.replace("++", "+").replace("*+", "*").replace(r"([+/_=-])\1{3}", r"\+{4}|/{4}|_{4}|={4}|-{4}") for x in secrets.ALLOW]
    allowed = " OR ".join(f"regexp_matches(hit, {_literal(x)})" for x in allow)
    window = f"list_max(list_transform(range(1, length(hit) - {secrets.WINDOW} + 2), lambda i: list_aggregate(string_split(substr(hit, i, {secrets.WINDOW}), ''), 'entropy')))"
    fits = " OR ".join("(" + " AND ".join(f"regexp_matches(hit, {_literal(x)})" for x in (made, *holds)) + f" AND {window} >= {bits} - 1e-9)" for made, holds, bits in secrets.CLASSES.values())
    parts = [
        _spans("assign", r"""(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(part) >= 8", 1),
        _spans("access", "AKIA[A-Z0-9]+", "length(hit) >= 16"),
        _spans("hex", "[0-9a-f]+", "length(hit) >= 32"),
        _spans("entropy_all", rf"[A-Za-z0-9+/_=-]{{{secrets.WINDOW},}}", f"NOT ({allowed}) AND ({fits})"),
        f"entropy AS ({_apart('entropy_all', secrets.KINDS[: secrets.BASE])})",
        "every AS (" + " UNION ALL ".join(f"SELECT doc_id, start, stop, {no} AS no, '{k}' AS kind FROM {k}" for no, k in enumerate(secrets.KINDS)) + ")",
    ]
    return f"WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(parts)} {_answer(secrets.KINDS, secrets.BASE)}"


def oracle_sql() -> dict[str, str]:
    return {"op5_pii": personal(), "op6_secrets": credentials(), "op7_decontam": contamination(), "op8_embedding_join": vectors(), "op9_ngram_jaccard": jaccard()}
