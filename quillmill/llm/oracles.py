"""DuckDB SQL for the operators that SQL can express, and the parameters both sides share."""

from __future__ import annotations

#: Rules of the URL filter query (host and path in one string).
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Target shares of the mixing query; the other sources share the rest equally.
MIX_WEIGHTS = {"src0": 0.25}
MIX_SEED = 17

_rules = ", ".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for r, v in URL_RULES)
_upper, _lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URLS = f"""
WITH rules(rule, rule_host, rule_path, verdict) AS (VALUES {_rules}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_upper}', '{_lower}') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, coalesce(r, '') AS r FROM rest)
), met AS (
  SELECT p.page_id, p.host, p.path, u.rule, u.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(u.rule) DESC NULLS LAST, u.verdict DESC) AS k
  FROM parts p LEFT JOIN rules u ON (p.host = u.rule_host OR ends_with(p.host, '.' || u.rule_host)) AND starts_with(p.path, u.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM met WHERE k = 1
"""

_shares = " ".join(f"WHEN source = '{s}' THEN {w}" for s, w in MIX_WEIGHTS.items())
_named = ", ".join(f"'{s}'" for s in MIX_WEIGHTS)
_present = " + ".join(f"CASE WHEN count(*) FILTER (WHERE source = '{s}') > 0 THEN {w} ELSE 0 END" for s, w in MIX_WEIGHTS.items())

MIX = f"""
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source
), totals AS (
  SELECT sum(size) AS total, count(*) FILTER (WHERE source IS NULL OR source NOT IN ({_named})) AS others, {_present} AS given FROM sizes
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN (CASE {_shares} ELSE {1 - sum(MIX_WEIGHTS.values())} / others END) / (given + CASE WHEN others > 0 THEN {1 - sum(MIX_WEIGHTS.values())} ELSE 0 END) * total / size ELSE 1 END AS mean
  FROM sizes, totals
), draws AS (SELECT source, mean, greatest(1, CAST(ceil(mean / 64.0) AS INT)) AS m FROM rates),
cdf AS (
  SELECT source, m, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM (
    SELECT source, m, k, exp(-mean / m + k * ln(mean / m) - lgamma(k + 1)) AS p FROM draws, range(0, 400) AS r(k) WHERE mean > 0)
), drawn AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, r.m, j.j,
         CAST(('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || j.j), 1, 12)) AS BIGINT) / 281474976710656.0 AS u
  FROM documents d JOIN draws r ON d.source IS NOT DISTINCT FROM r.source, range(1, 100) AS j(j) WHERE j.j <= r.m
), lists AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
counted AS (
  SELECT doc_id, lang, d.source, n_chars, text, CAST(sum(len(list_filter(cs, lambda c: c <= u))) AS INT) AS copies
  FROM drawn d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copies, CAST(k AS INT) AS copy,
       md5('order{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || k) AS shuffle_key
FROM counted, range(1, 1000) AS c(k) WHERE k <= copies
"""

_lanes = 256


def _lines(text: str) -> str:
    return f"(CASE WHEN {text} = '' THEN [] ELSE list_transform(string_split({text}, chr(10)), lambda x: sha256(x)) END)"


def _stretches(text: str) -> str:
    """SQL of a text's stretches of words, counted by lane and sign."""
    sentences = f"regexp_replace({text}, '([.!?]) ', '\\1' || chr(10), 'g')"
    parts = f"list_transform(list_concat(regexp_extract_all({sentences}, '[^ \\n]+(?: [^ \\n]+){{3}}'), list_filter(string_split({text}, chr(10)), lambda x: x <> '')), lambda s: CAST('0x' || substr(md5(s), 1, 4) AS BIGINT) % {2 * _lanes})"
    return f"list_aggregate({parts}, 'histogram')"


def _sums(lines: str, counts: str) -> str:
    """SQL of the vector from columns of hashes and counts."""
    whole = f"list_transform(range(0, 8), lambda k: CAST(coalesce(list_sum(list_transform({lines}, lambda h: CAST('0x' || substr(h, CAST(8 * k + 1 AS INT), 8) AS BIGINT))), 0) % 4294967296 AS BIGINT))"
    count = lambda bin: f"coalesce(CAST({counts}[{bin}] AS BIGINT), 0)"
    lanes = f"list_transform(range(0, {_lanes}), lambda k: ({count('2 * k')} - {count('2 * k + 1')} + 4294967296) % 4294967296)"
    return f"list_concat({whole}, {lanes})"


def _hex(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: lpad(lower(to_hex(x)), 8, '0')), '')"


def _like(a: str, b: str) -> str:
    signed = lambda v: f"list_transform(list_slice({v}, 9, {8 + _lanes}), lambda x: CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END)"
    product = lambda x, y: f"CAST(list_sum(list_transform(list_zip({signed(x)}, {signed(y)}), lambda p: p[1] * p[2])) AS DOUBLE)"
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE greatest(0.0, least(1.0, coalesce({product(a, b)} / nullif(sqrt({product(a, a)} * {product(b, b)}), 0), 0.0))) END"


FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, t)),
e AS (SELECT doc_id, t, nx, length(t) AS n_chars, substr(t, 1, length(t) - length(t) // 3) || substr(nx, 1, length(t) // 3) AS ed FROM n),
h AS (SELECT doc_id, n_chars, ed, {_lines('t')} AS lt, {_lines('ed')} AS le, {_lines('nx')} AS ln, {_stretches('t')} AS st, {_stretches('ed')} AS se, {_stretches('nx')} AS sn FROM e),
v AS (SELECT doc_id, n_chars, ed, {_sums('lt', 'st')} AS a, {_sums('le', 'se')} AS b, {_sums('ln', 'sn')} AS c FROM h)
SELECT doc_id, n_chars, sha256(ed) AS edited_sha256, {_hex('a')} AS fingerprint, {_hex('b')} AS edited_fingerprint,
       CAST({_like('a', 'b')} AS DOUBLE) AS near_edited, CAST({_like('a', 'c')} AS DOUBLE) AS near_next
FROM v
"""

REPEATS = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d WHERE len(ws) >= 13),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY list_slice(ws, p, p + 12)) AS first FROM w),
gone AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(p, p + 13))))) AS r FROM f WHERE first < doc_id GROUP BY doc_id),
k AS (SELECT d.doc_id, len(ws) AS n, coalesce(len(r), 0) AS g,
             CASE WHEN r IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(r, i)), lambda i: ws[i]) END AS kept
      FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

TOP_K = """
WITH w AS (
  SELECT vec_id, max(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE)))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
g AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def _lloyd(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Every vector compared with every centroid, round by round."""
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY key NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS key, x FROM v ORDER BY key NULLS LAST, x LIMIT {k})
)"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT i, vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.i, v.vec_id, v.x, c.c, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r} c) GROUP BY i, vec_id, x
)""")  # fmt: skip
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT c, list(CAST(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS BIGINT) ORDER BY p) AS x
  FROM (SELECT c, p, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS p FROM a{r}) GROUP BY c, p) GROUP BY c
), c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)""")  # fmt: skip
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


K_MEANS = _lloyd()

SQL = {
    "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op13_ball_k_means": K_MEANS,
    "op3_kd_tree_topk": TOP_K,
    "op6_super_kmer_dedup": REPEATS,
    "op4_url_rules": URLS,
    "op5_multiset_fingerprint": FINGERPRINTS,
    "op9_poisson_mixing": MIX,
}
