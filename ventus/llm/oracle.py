"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

WORD_SPANS = rf"""WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS.format("text")} END AS ws FROM documents),
 windows AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS pos FROM w)),
 late AS (SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1),
 gone AS (SELECT DISTINCT doc_id, pos + k AS i FROM late, (SELECT unnest(range(0, 20)) AS k)),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_COMPONENTS = "reach AS (SELECT id AS node, id AS component FROM ids UNION SELECT e.b, r.component FROM reach r JOIN links e ON e.a = r.node), least AS (SELECT node, min(component) AS component FROM reach GROUP BY node)"

NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
 sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 pairs AS (SELECT a, b FROM both_ p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
 links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), ids AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT w.doc_id, coalesce(sizes.n, 0) AS n_shingles, component AS component_id, component = w.doc_id AS kept FROM w JOIN least ON node = w.doc_id LEFT JOIN sizes ON sizes.doc_id = w.doc_id"""

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 ids AS (SELECT id FROM v), {_COMPONENTS}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n.n, 0) AS n_links, component AS component_id, component = id AS kept FROM ids JOIN least ON node = id LEFT JOIN n ON n.a = id"""

BYTE_STRINGS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d),
 w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 200 <= len(h) THEN md5_number(substr(h, 2 * i + 1, 200)) END AS g FROM p),
 late AS (SELECT doc_id, i, byte, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS late FROM w),
 cut AS (SELECT doc_id, i, byte, coalesce(i - max(CASE WHEN late THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 100, false) AS gone FROM late),
 runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM cut),
 n AS (SELECT doc_id, count(CASE WHEN gone THEN 1 END) AS n_removed, count(CASE WHEN opens THEN 1 END) AS n_spans, string_agg(CASE WHEN NOT gone THEN byte END, '' ORDER BY i) AS kept FROM runs GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id)"""

TEXT_STATS = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
 grams AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, pos, array_to_string(ws[pos:pos + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS pos FROM w))),
 again AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM grams, (SELECT unnest(range(0, 8)) AS k) WHERE grams.n > 1 GROUP BY doc_id),
 lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
 len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM w JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id))"""

#: Vectors that are kept, as integers, a row for each component i from 0.
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_POINTS = """kept AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {kept}),
 p AS MATERIALIZED (SELECT vec_id, i - 1 AS i, CAST(floor({scale} * e[i]) AS BIGINT) AS x FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM kept))"""


def _floor_mean(total: str, n: str) -> str:
    """floor(total / n) of integers, without a division that rounds."""
    return f"CAST((({total}) - ((({total}) % ({n})) + ({n})) % ({n})) // ({n}) AS BIGINT)"


def _clusters(k: int, rounds: int, seed: int) -> str:
    steps = [_POINTS.format(kept=f"len(embedding) = 64 AND {_FINITE}", scale=1024)]
    steps.append(f"first_ AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k})")
    steps.append("m0 AS MATERIALIZED (SELECT c, i, x FROM p JOIN first_ USING (vec_id))")
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, c, sum((p.x - m.x) * (p.x - m.x)) AS d FROM p JOIN m{r} m USING (i) GROUP BY ALL)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        moved = f"SELECT c, i, {_floor_mean('sum(x)', 'count(*)')} AS x FROM p JOIN a{r} USING (vec_id) GROUP BY c, i"
        steps.append(f"m{r + 1} AS MATERIALIZED (SELECT c, i, coalesce(n.x, m.x) AS x FROM m{r} m LEFT JOIN ({moved}) n USING (c, i))")
    told = f"SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS "cluster", CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN ({told}) USING (c)"""


CLUSTERS = _clusters(8, 10, 3)


def _vector_codes(parts: int, entries: int, rounds: int) -> str:
    steps = [_POINTS.format(kept=f"len(embedding) > 0 AND {_FINITE}", scale=256)]
    steps.append(f"q AS MATERIALIZED (SELECT vec_id, i // w AS part, i % w AS place, x FROM p, (SELECT any_value(len(e)) // {parts} AS w FROM kept))")
    steps.append(f"first_ AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM kept QUALIFY c < {entries})")
    steps.append("m0 AS MATERIALIZED (SELECT part, c, place, x FROM q JOIN first_ USING (vec_id))")
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, part, c, sum((q.x - m.x) * (q.x - m.x)) AS d FROM q JOIN m{r} m USING (part, place) GROUP BY ALL)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY vec_id, part)")
        moved = f"SELECT part, c, place, {_floor_mean('sum(x)', 'count(*)')} AS x FROM q JOIN a{r} USING (vec_id, part) GROUP BY ALL"
        steps.append(f"m{r + 1} AS MATERIALIZED (SELECT part, c, place, coalesce(n.x, m.x) AS x FROM m{r} m LEFT JOIN ({moved}) n USING (part, c, place))")
    steps.append(f"told AS (SELECT vec_id, string_agg(printf('%02x', c), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, c, place)) FROM m{rounds}) AS codebooks_sha256 FROM told JOIN kept USING (vec_id)"""


VECTOR_CODES = _vector_codes(16, 64, 2)

#: (kind, pattern, group and least length of it), written out apart from the rules that the operator has.
_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("repository_token", r"gh[opsru]_[A-Za-z0-9]+", 0, 40),
    ("chat_token", r"xox[abeprs]-[A-Za-z0-9-]+", 0, 20),
    ("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("payment_key", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    ("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", 0, 1),
    ("bearer", r"(?i)bearer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20),
]


def _matches(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    """Where matches of a pattern lie, from the lengths of what is between them."""
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, list_sum(list_transform(between_[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:k - 1], lambda x: length(x))), 0) AS s, length(whole[k]) AS n FROM
 (SELECT doc_id, whole, own, between_, unnest(range(1, len(whole) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', {group}) AS own, string_split_regex(t, '{pattern}') AS between_ FROM d WHERE regexp_matches(t, '{pattern if kind != "hex" else "[0-9a-f]{32}"}')))
 WHERE length(own[k]) >= {least}"""


_TOLD = "string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank)"
_COUNTS = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in ("assign", "access", "hex"))
SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(_matches(*row, rank) for rank, row in enumerate(_KINDS))}),
 g AS (SELECT doc_id, {_COUNTS}, {_TOLD} FILTER (rank < 3) AS base, {_TOLD} AS spans FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""
