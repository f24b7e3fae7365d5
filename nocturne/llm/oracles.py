"""The same results in DuckDB SQL, where SQL can express them.

Written from the operators' definitions: exact counts, all windows, all pairs. Learned
models of other kinds (toxicity, language, quality rules) and byte-wise removal have none;
they are tested against brute force, round trips and held-out accuracy.
"""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _mix(block_rows: int = 100, cycle: int | str = 1000, weights: str | None = None) -> str:
    natural = f"""e AS (SELECT s, pow(n, 0.5) * ({cycle} - (SELECT count(*) FROM n)) / (SELECT sum(pow(n, 0.5)) FROM n) AS x FROM n),
p AS (SELECT s, floor(x) AS f, round(x - floor(x), 9) AS o FROM e),
w AS (
  SELECT s, (1 + f + CASE WHEN row_number() OVER (ORDER BY o DESC, s)
                 <= {cycle} - (SELECT count(*) FROM n) - (SELECT sum(f) FROM p) THEN 1 ELSE 0 END)::BIGINT AS w FROM p
)"""
    given = f"w AS (SELECT s, ({weights})::BIGINT AS w FROM n)"
    return f"""
WITH RECURSIVE n AS (SELECT coalesce(source, '(none)') AS s, count(*) AS n FROM documents GROUP BY 1),
{given if weights else natural},
packed AS (SELECT list(s ORDER BY s) AS names, list(w ORDER BY s) AS ws, {cycle} AS cyc FROM w),
sched AS (
  SELECT -1 AS t, list_transform(ws, lambda x: 0) AS used, 0::BIGINT AS pick, ws, cyc FROM packed
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(ws) + 1), lambda i: used[i] + CASE WHEN i = now THEN 1 ELSE 0 END), now, ws, cyc
  FROM (
    SELECT t, used, ws, cyc, list_min(list_transform(range(1, len(ws) + 1), lambda i:
      CASE WHEN floor(used[i] * cyc / ws[i]) <= t + 1 AND used[i] < ws[i]
           THEN ceil((used[i] + 1) * cyc / ws[i])::BIGINT * 100000 + i END)) % 100000 AS now
    FROM sched WHERE t < cyc - 1
  )
),
turns AS (
  SELECT names[pick] AS s, t AS place, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM sched, packed WHERE t >= 0
),
ranked AS (
  SELECT doc_id, source, coalesce(source, '(none)') AS s,
         row_number() OVER (PARTITION BY coalesce(source, '(none)') ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r
  FROM documents
),
blocks AS (SELECT ranked.*, r // {block_rows} AS b, w FROM ranked JOIN w USING (s))
SELECT doc_id, source, r AS source_rank, b AS block, floor(b * {cycle} / w)::BIGINT AS release,
       ceil((b + 1) * {cycle} / w)::BIGINT AS deadline, (b // w) * {cycle} + place AS slot,
       ((b // w) * {cycle} + place) * {block_rows} + r % {block_rows} AS mix_order
FROM blocks JOIN turns ON blocks.s = turns.s AND b % w = turns.turn
"""


_ALLOWED = """(NOT regexp_matches(v, '^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$')
   AND NOT regexp_matches(v, '(?i)example|sample|placeholder|changeme|dummy|redacted')
   AND NOT regexp_matches(v, '^(?:[A-Za-z]+[/_=-])+[A-Za-z]+[0-9]*$') AND NOT regexp_matches(v, '^[A-Za-z]+[0-9]+$'))"""


def _secrets() -> str:
    kinds = [
        ("assign", 0, r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, "length(v) >= 12"),
        ("access", 1, "AKIA[A-Z0-9]+", 0, "length(v) >= 18"),
        ("hex", 2, "[0-9a-f]+", 0, "length(v) >= 16"),
        ("entropy_hex", 3, "[0-9A-Fa-f]+", 0, f"length(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Fa-f]') AND {_ALLOWED}"),
        ("entropy_base64", 4, "[A-Za-z0-9+/_=-]+", 0, f"length(v) >= 24 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND {_ALLOWED}"),
        ("entropy_lower", 5, "[a-z0-9]+", 0, f"length(v) >= 24 AND regexp_matches(v, '[0-9].*[a-z].*[0-9].*[a-z].*[0-9]') AND {_ALLOWED}"),
    ]
    found = " UNION ALL ".join(
        f"""
  SELECT doc_id, '{kind}' AS kind, {turn} AS turn, a, a + length(m) AS z, v FROM (
    SELECT doc_id, m, v, sum(length(g)) OVER (PARTITION BY doc_id ORDER BY i)
           + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
    FROM (SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs,
             string_split_regex(t, '{pattern}') AS gs FROM d))
  ) WHERE {keep}"""
        for kind, turn, pattern, group, keep in kinds
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({found}),
moved AS (
  SELECT *, unnest(range(0, length(v) - width + 1)) AS o FROM (
    SELECT *, CASE turn WHEN 3 THEN 16 ELSE 24 END AS width, CASE turn WHEN 3 THEN 2.8 WHEN 4 THEN 3.9 ELSE 3.7 END AS least
    FROM raw WHERE turn > 2)
),
hits AS (
  SELECT doc_id, kind, turn, a + min(o) AS a, a + max(o) + any_value(width) AS z FROM moved
  WHERE list_aggregate(string_split(CASE turn WHEN 3 THEN lower(v[o + 1:o + width]) ELSE v[o + 1:o + width] END, ''), 'entropy') >= least - 1e-9
  GROUP BY doc_id, kind, turn, a, v
),
known AS (SELECT doc_id, kind, turn, a, z FROM raw WHERE turn <= 2),
fresh AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.doc_id = h.doc_id AND k.a < h.z AND h.a < k.z)),
base AS (
  SELECT doc_id, count(*) FILTER (turn = 0) AS n_assign, count(*) FILTER (turn = 1) AS n_access, count(*) FILTER (turn = 2) AS n_hex,
         string_agg(kind || ':' || a::BIGINT || ':' || z::BIGINT, ',' ORDER BY a, turn) AS l FROM known GROUP BY 1
),
every AS (
  SELECT doc_id, string_agg(kind || ':' || a::BIGINT || ':' || z::BIGINT, ',' ORDER BY a, turn) AS l
  FROM (SELECT doc_id, kind, turn, a, z FROM known UNION ALL SELECT doc_id, kind, turn, a, z FROM fresh) GROUP BY 1
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base.l, '')) AS base_sha256, coalesce(every.l, '') AS spans
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""


def _urls(order: int = 3) -> str:
    pad = "chr(2)" if order else "''"
    steps = []
    for k in range(order + 1):
        context = f"left(pair, {k})" if k else "''"
        below = "1.0 / 256, 1.0 / 256" if k == 0 else "b.gp, b.bp"
        join = "" if k == 0 else f"JOIN p{k - 1} b ON b.pair = right(x.pair, {k})"
        steps.append(f"""
x{k} AS (SELECT right(win, {k + 1}) AS pair, sum(good) AS good, sum(bad) AS bad FROM counts GROUP BY 1),
c{k} AS (SELECT {context} AS ctx, sum(good) AS ga, count(*) FILTER (good > 0) AS gk, sum(bad) AS ba, count(*) FILTER (bad > 0) AS bk FROM x{k} GROUP BY 1),
j{k} AS (SELECT x.pair, good, bad, ga, gk, ba, bk, {below.split(", ")[0]} AS gb, {below.split(", ")[1]} AS bb
         FROM x{k} x JOIN c{k} c ON c.ctx = {context.replace("pair", "x.pair")} {join}),
p{k} AS (SELECT pair, CASE WHEN ga + gk = 0 THEN gb ELSE (good + gk * gb) / (ga + gk) END AS gp,
                CASE WHEN ba + bk = 0 THEN bb ELSE (bad + bk * bb) / (ba + bk) END AS bp FROM j{k})""")
    return f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_AZ}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
),
rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
texts AS (SELECT DISTINCT host, path FROM u),
fits AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM texts JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
                       AND starts_with(path, substring(rule, length(split_part(rule, '/', 1)) + 1))
  GROUP BY 1, 2
),
t AS (SELECT host, path, rule, verdict, left(md5(host || path), 1) IN ('0', '1', '2', '3') AS held FROM texts LEFT JOIN fits USING (host, path)),
s AS (
  SELECT *, substring(padded, i, {order + 1}) AS win FROM (
    SELECT *, unnest(range(1, length(padded) - {order} + 1)) AS i FROM (
      SELECT *, repeat({pad}, {order}) || host || path || chr(3) AS padded FROM t))
),
counts AS (
  SELECT win, count(*) FILTER (NOT held AND verdict = 'allow') AS good, count(*) FILTER (NOT held AND verdict = 'block') AS bad FROM s GROUP BY 1
),{",".join(steps)},
scored AS (
  SELECT host, path, any_value(rule) AS rule, any_value(verdict) AS verdict, bool_or(held) AS held,
         round(greatest(-10.0, least(10.0, avg(ln(gp) - ln(bp)))) * 100)::INT AS cell
  FROM s JOIN p{order} ON pair = win GROUP BY 1, 2
),
cells AS (
  SELECT cell, count(*) FILTER (verdict = 'allow') AS g, count(*) FILTER (verdict = 'block') AS b
  FROM scored WHERE held AND verdict IS NOT NULL GROUP BY 1
),
best AS (
  SELECT cell FROM (
    SELECT cell, sum(g) OVER (ORDER BY cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / nullif(sum(g) OVER (), 0)
           + coalesce(sum(b) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nullif(sum(b) OVER (), 0) AS q FROM cells)
  WHERE q IS NOT NULL ORDER BY round(q, 9) DESC, cell LIMIT 1
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN cell >= coalesce((SELECT cell FROM best), 0) THEN 'allow' ELSE 'block' END) AS verdict
FROM u JOIN scored USING (host, path)
"""


def _words(gaps: str) -> str:
    return f"list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '{gaps}'), lambda x: x <> '')"


def _decontaminate() -> str:
    words = _words(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
iw AS (
  SELECT item_id, l, w[s:s + l - 1] AS k FROM (
    SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, l, s, w[s:s + l - 1] AS k FROM (
    SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)
),
m AS (SELECT doc_id, s, l, item_id FROM dw JOIN iw USING (l, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM m GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY 1)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g USING (h)
"""


def _classes(percent: int, more: str = "") -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(r"[\x20\x09-\x0D]+")} AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, w[s:s + 4] AS k FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)
),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, low) AS component_id{more}
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""


_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
       coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM l LEFT JOIN c USING (doc_id)
"""

_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


ORACLES: dict[str, str] = {
    "op1_mix": _mix(),
    "op1_target_weights": _mix(10, "(SELECT sum(w) FROM w)::BIGINT", "2 + length(s) % 5"),
    "op2_secrets": _secrets(),
    "op3_urls": _urls(),
    "op5_decontaminate": _decontaminate(),
    "op7_warc": _WARC,
    "op9_base": _QUALITY,
    "op10_minhash": _classes(75, ", d.doc_id = least(d.doc_id, low) AS kept"),
    "op12_negatives": _NEGATIVES,
    "op13_jaccard": _classes(80),
}
