"""The queries that SQL of another engine can express, written out independently of the plans."""

from __future__ import annotations

from skein.llm import quality

WORD = "[^\\x20\\x09-\\x0D]+"


def _op7_sql() -> str:
    """Repetition coverage by windows over words. `[^ \\t-\\r]` is written with escapes that both engines read."""
    word, parts, joins, over = WORD, [], [], []
    for n, most in quality.LIMITS:
        gram = " || ' ' || ".join(["w", *(f"lead(w, {j}) OVER p" for j in range(1, n))])
        parts.append(
            f"g{n} AS (SELECT doc_id, i, w, {gram} AS g FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)), "
            f"r{n} AS (SELECT doc_id, i, w, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS r FROM g{n}), "
            f"m{n} AS (SELECT doc_id, w, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m FROM r{n}), "
            f"c{n} AS (SELECT doc_id, sum(m) AS k{n}, sum(m * length(w)) AS ch{n} FROM m{n} GROUP BY doc_id)"
        )
        joins.append(f"LEFT JOIN c{n} USING (doc_id)")
        over.append(f"(word_chars > 0 AND CAST(coalesce(ch{n}, 0) AS DOUBLE) / word_chars > CAST({most} AS DOUBLE))")
    over += [f"(word_chars > 0 AND CAST(coalesce(line_chars, 0) AS DOUBLE) / word_chars > CAST({quality.LINE_LIMIT} AS DOUBLE))", f"n_symbols > CAST({quality.SYMBOL_LIMIT} AS DOUBLE) * word_chars"]
    failed = f"(n_words < {quality.MIN_WORDS} OR 100 * coalesce(k5, 0) > {quality.BASE_PERCENT} * n_words)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
{", ".join(parts)},
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, line, count(*) AS n FROM l0 WHERE regexp_matches(line, '{word}') GROUP BY doc_id, line),
dup AS (SELECT doc_id, sum(n - 1) AS dup, sum((n - 1) * length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS line_chars FROM l GROUP BY doc_id),
b AS (SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(k5, 0) AS BIGINT) AS n_repeat_words,
  {failed} AS base_failed, NOT {failed} AND NOT ({" OR ".join(over)}) AS kept
FROM b LEFT JOIN dup USING (doc_id) {" ".join(joins)}"""


#: From links (a, b) in both directions and nodes (id): the least id that each can reach.
_REACH = "r(id, c) AS (SELECT id, id FROM nodes UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a), least AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least ON least.id = d.doc_id"""

OP4 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL),
good AS (SELECT id, x FROM v WHERE len(x) > 0 AND len([y for y in x if y IS NULL OR NOT isfinite(y)]) = 0 AND len([y for y in x if y <> 0]) > 0),
l AS (SELECT a.id AS a, b.id AS b FROM good a JOIN good b ON a.id < b.id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH},
k AS (SELECT a AS id, count(*) AS n FROM e GROUP BY a)
SELECT nodes.id AS vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, component_id, nodes.id = component_id AS kept FROM nodes JOIN least USING (id) LEFT JOIN k USING (id)"""


def _spans(rules: list[tuple[str, str, str]], base: list[str], by: str) -> str:
    """rules: kind, pattern, and what a match m must pass, p being what stands before it. Places are running sums of the lengths of both."""
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM d" for k, (kind, pattern, _) in enumerate(rules))
    passes = " OR ".join(f"(kind = '{kind}' AND {test})" for kind, _, test in rules)
    order = {"kind": "k, s", "start": "s, k"}[by]
    kinds = ", ".join(f"'{k}'" for k in base)
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS n_{k}" for k in base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({found}),
m AS (SELECT doc_id, k, kind, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM f),
x AS (SELECT doc_id, k, kind, m, p, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS e FROM m),
ok AS (SELECT doc_id, k, kind, e - length(m) AS s, e FROM x WHERE {passes}),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order}) FILTER (WHERE kind IN ({kinds})) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order}) AS spans FROM ok GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN i % 2 = 0 THEN CAST({_DIGITS}[len({_DIGITS}) - i + 1] AS INTEGER) * 2 - CASE WHEN CAST({_DIGITS}[len({_DIGITS}) - i + 1] AS INTEGER) > 4 THEN 9 ELSE 0 END ELSE CAST({_DIGITS}[len({_DIGITS}) - i + 1] AS INTEGER) END for i in range(1, len({_DIGITS}) + 1)]) % 10 = 0"
#: The fixed kinds. Spans of contexts come from rounds over all texts, which SQL does not express: the tables' identifiers stand in random prose, where no context is found.
OP8 = _spans(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len([q for q in string_split(m, '.') if length(ltrim(q, '0')) > 3 OR CAST('0' || substr(ltrim(q, '0'), 1, 3) AS INTEGER) > 255]) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE FALSE END"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    ],
    ["email", "ip", "card", "phone"],
    "kind",
)

_ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?"
OP9 = _spans(
    [
        ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, '^{_ASSIGN}', '')) >= 12"),
        ("access", "AKIA[A-Z0-9]+", "length(m) >= 18"),
        ("hex", "[0-9a-f]+", "length(m) >= 16"),
        ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "TRUE"),
        ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", "TRUE"),
        ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "NOT regexp_matches(p, '[.-]$')"),
    ],
    ["assign", "access", "hex"],
    "start",
)

SQL: dict[str, str] = {"op1_minhash_near_dedup": OP1, "op4_embedding_near_dedup": OP4, "op7_quality_rules": _op7_sql(), "op8_pii": OP8, "op9_secret_scan": OP9}
