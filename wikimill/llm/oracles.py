"""DuckDB SQL for the queries that SQL can express. Mixing, scoring, tokenizing, classifying, edit search and
rules on a CRC are left to tests."""

from __future__ import annotations

from . import line_dedup
from .license_scan import BASE, SENTENCES

ORACLES: dict[str, str] = {}

_WORDS = "list_filter(string_split_regex({text}, '[ \\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    templates = BASE + SENTENCES
    stride = max(32, *(len(t.words) for t in templates))
    rows = ", ".join(f"({i}, '{t.label}', {str(t.phrase).lower()}, {t.words!r}, {t.needed})" for i, t in enumerate(templates))
    return f"""
WITH t(template, label, phrase, words, needed) AS (VALUES {rows}),
d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT doc_id, s, list_slice(w, s + 1, s + {2 * stride}) AS w FROM (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 1, 0), {stride})) AS s FROM d)),
c AS (SELECT b.doc_id, b.s, b.w, t.*, len(list_intersect(list_distinct(b.w), list_distinct(t.words))) AS common FROM b, t),
h AS (SELECT doc_id, template, label, phrase, common / len(list_distinct(words)) AS containment,
  CASE WHEN phrase THEN list_transform(list_filter(generate_series(0, least({stride}, len(w)) - 1), lambda p: list_slice(w, p + 1, p + len(words)) = words), lambda p: p + s) ELSE [] END AS places
  FROM c WHERE common >= needed),
k AS (SELECT * FROM h WHERE NOT phrase OR len(places) > 0),
g AS (SELECT doc_id, sum(CASE WHEN phrase THEN len(places) ELSE 0 END) AS n_base, min(CASE WHEN phrase THEN list_min(places) END) AS first_word,
  max(CASE WHEN phrase THEN list_max(places) END) AS last_word,
  string_agg(DISTINCT CASE WHEN phrase THEN label END, ',' ORDER BY CASE WHEN phrase THEN label END) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.n_base, 0) AS BIGINT) AS n_base, CAST(g.first_word AS BIGINT) AS first_word,
  CAST(g.last_word AS BIGINT) AS last_word, coalesce(g.base_labels, '') AS base_labels, coalesce(g.labels, '') AS labels, CAST(coalesce(g.score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (doc_id)"""


ORACLES["op1_license_scan"] = _license_sql()

_W = line_dedup.WINDOW
_STEP = ", ".join(f"lead(x, {j}) OVER n AS x{j}, lead(i, {j}) OVER n AS i{j}" for j in range(1, _W))
_SAME = ", ".join(["x", *(f"x{j}" for j in range(1, _W))])
ORACLES["op3_line_dedup"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, i, x, {_STEP} FROM l WHERE trim(x) <> '' WINDOW n AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, [i, {', '.join(f'i{j}' for j in range(1, _W))}] AS ats, row_number() OVER (PARTITION BY {_SAME} ORDER BY doc_id, i) AS k FROM f WHERE x{_W - 1} IS NOT NULL),
r AS (SELECT DISTINCT doc_id, unnest(ats) AS i FROM w WHERE k > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(r.i) AS n_removed, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE r.i IS NULL) AS kept
  FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.i = r.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)"""

ORACLES["op5_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c(node, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT c.node, p.b FROM c JOIN p ON c.reach = p.a),
m AS (SELECT node, min(reach) AS component_id FROM c GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m ON s.doc_id = m.node"""

ORACLES["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents"""

ORACLES["op8_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d)),
m AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x HAVING min(doc_id) < max(doc_id)),
h AS (SELECT s.doc_id, s.p FROM s JOIN m ON s.x = m.x AND s.doc_id > m.first),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS i FROM h),
l AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT l.doc_id, count(g.i) AS n_removed, string_agg(l.v, ' ' ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_DISTANCE = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) AS BIGINT)"


def _centroids_sql() -> str:
    steps = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM v QUALIFY c < 16)"]
    for i in range(4):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v.r, min({{'d': {_DISTANCE}, 'c': c.c}}) AS m FROM v, c{i} c GROUP BY v.r)")
        if i < 3:
            steps.append(f"""s{i} AS (SELECT c, p, sum(x) AS x, count(*) AS n FROM (SELECT a.m.c AS c, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS p FROM a{i} a JOIN v USING (r)) GROUP BY c, p),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list(CAST((x - ((x % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM s{i} GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, CAST(a.m.c AS INTEGER) AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM v JOIN a3 a USING (r) JOIN c3 ON c3.c = a.m.c"""


ORACLES["op11_centroids"] = _centroids_sql()
