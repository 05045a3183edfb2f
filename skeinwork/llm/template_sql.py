"""DuckDB SQL of the template decontamination: the same rows as ``decontaminate.leaks`` over documents and benchmark.

Windows are compared as words here, not as hashes.  Items under a window's length, the ways in which an item is looked
for, and alignments that are judged apart are all there.
"""

from __future__ import annotations

from .decontaminate import EXACT, LITERALS, NAMED, NEAR, PATTERN, SHARE, UNITS, WINDOW

_UNITS = ", ".join(f"'{u}'" for u in UNITS)
_PATTERN = PATTERN.replace("'", "''")
_SLOTS = "('<num>', '<unit>', '<name>')"
_PLAIN = f"len(list_filter(ts[begin_at + 1:begin_at + w], lambda t: t NOT IN {_SLOTS}))"
_KEYS = "doc_id, item_id, way"
SQL = f"""
WITH raws AS (
  SELECT 0 AS src, doc_id AS id, regexp_extract_all(coalesce(text, ''), '{_PATTERN}') AS raw FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(coalesce(text, ''), '{_PATTERN}') FROM benchmark WHERE item_id IS NOT NULL
), each AS (
  SELECT src, id, unnest(raw) AS v, unnest(range(len(raw))) AS i FROM raws
), prev AS (
  SELECT *, lag(v) OVER (PARTITION BY src, id ORDER BY i) AS p FROM each
), typed AS (
  SELECT src, id, i, v, CASE WHEN v IN ('.', '!', '?') THEN NULL
    WHEN v >= '0' AND v < ':' THEN '<num>'
    WHEN p IS NOT NULL AND p >= '0' AND p < ':' AND lower(v) IN ({_UNITS}) THEN '<unit>'
    WHEN p IS NOT NULL AND substr(v, 1, 1) BETWEEN 'A' AND 'Z' AND substr(v, 2, 1) BETWEEN 'a' AND 'z' AND p NOT IN ('.', '!', '?') THEN '<name>'
    ELSE lower(v) END AS t FROM prev
), texts AS (
  SELECT src, id, list(t ORDER BY i) AS ts, list(lower(v) ORDER BY i) AS vs, arg_min(v, i) AS opening FROM typed WHERE t IS NOT NULL GROUP BY src, id
), plain_ways AS (
  SELECT id AS item_id, 0 AS way, ts, vs FROM texts WHERE src = 1
  UNION ALL
  SELECT id, {NAMED}, list_concat(['<name>'], ts[2:]), vs FROM texts
  WHERE src = 1 AND substr(opening, 1, 1) BETWEEN 'A' AND 'Z' AND substr(opening, 2, 1) BETWEEN 'a' AND 'z' AND ts[1] = lower(opening)
), windows AS (
  SELECT item_id, way, ts, vs, least(len(ts), {WINDOW}) AS w, unnest(range(0, len(ts) - least(len(ts), {WINDOW}) + 1)) AS begin_at FROM plain_ways
), poor AS (
  SELECT DISTINCT item_id FROM windows WHERE len(ts) >= {LITERALS} AND {_PLAIN} < least(w, {LITERALS})
), ways AS (
  SELECT * FROM plain_ways UNION ALL SELECT id, {EXACT}, ts, vs FROM texts WHERE src = 1 AND id IN (SELECT item_id FROM poor)
), counting AS (
  SELECT item_id, way, w, begin_at AS bpos, array_to_string(ts[begin_at + 1:begin_at + w], ' ') AS key FROM windows WHERE {_PLAIN} >= least(w, {LITERALS})
  UNION ALL
  SELECT item_id, way, w, begin_at, array_to_string(vs[begin_at + 1:begin_at + w], ' ') FROM (
    SELECT item_id, way, vs, least(len(vs), {WINDOW}) AS w, unnest(range(0, len(vs) - least(len(vs), {WINDOW}) + 1)) AS begin_at FROM ways WHERE way = {EXACT})
), wanted AS (
  SELECT *, count(*) OVER (PARTITION BY item_id, way) AS total FROM counting
), sizes AS (
  SELECT DISTINCT way = {EXACT} AS exact, w FROM wanted
), places AS (
  SELECT id, ts, vs, exact, w, unnest(range(0, len(ts) - w + 1)) AS pos FROM texts, sizes WHERE src = 0 AND len(ts) >= w
), seen AS (
  SELECT id, exact, w, pos, array_to_string(CASE WHEN exact THEN vs[pos + 1:pos + w] ELSE ts[pos + 1:pos + w] END, ' ') AS key FROM places
), hits AS (
  SELECT DISTINCT s.id AS doc_id, b.item_id, b.way, s.pos, b.bpos, b.total, s.pos - b.bpos AS shift
  FROM seen s JOIN wanted b ON s.key = b.key AND s.w = b.w AND s.exact = (b.way = {EXACT})
), opens AS (
  SELECT *, count(*) OVER (PARTITION BY {_KEYS}) AS n, coalesce(shift - lag(shift) OVER (PARTITION BY {_KEYS} ORDER BY shift) > {NEAR}, true) AS opens
  FROM (SELECT DISTINCT {_KEYS}, shift FROM hits)
), runs AS (
  SELECT {_KEYS}, shift, max(CASE WHEN opens THEN shift END) OVER (PARTITION BY {_KEYS} ORDER BY shift) AS run, n FROM opens
), scopes AS (
  SELECT {_KEYS}, shift, 'shift ' || shift AS scope FROM runs WHERE n > 1 UNION ALL SELECT {_KEYS}, shift, 'run ' || run FROM runs WHERE n > 1
), judged AS (
  SELECT *, 'all' AS scope FROM hits UNION ALL SELECT hits.*, scope FROM hits JOIN scopes USING ({_KEYS}, shift)
), held AS (
  SELECT {_KEYS}, scope, total, count(DISTINCT bpos) AS n_matched FROM judged GROUP BY ALL HAVING count(DISTINCT bpos) * 100 >= total * {SHARE}
), theirs AS (
  SELECT item_id, way, unnest(range(len(ts))) AS bat, unnest(ts) AS bt, unnest(vs) AS bv FROM ways
), ours AS (
  SELECT id AS doc_id, unnest(range(len(ts))) AS dat, unnest(ts) AS dt, unnest(vs) AS dv FROM texts WHERE src = 0 AND id IN (SELECT doc_id FROM held)
), covered AS (
  SELECT DISTINCT doc_id, item_id, way, scope, bt, bv, bat + shift AS dat FROM judged JOIN held USING ({_KEYS}, scope) JOIN theirs USING (item_id, way)
  WHERE bt IN {_SLOTS} AND bat >= bpos AND bat < bpos + {WINDOW}
), per_value AS (
  SELECT {_KEYS}, scope, bt, bv, count(DISTINCT dv) AS kinds, max(CASE WHEN dv <> bv THEN 1 ELSE 0 END) AS changed
  FROM covered JOIN ours USING (doc_id, dat) WHERE bt = dt GROUP BY ALL
), slots AS (
  SELECT {_KEYS}, scope, count(*) AS n_slots, count(*) FILTER (kinds = 1) AS n_consistent, CAST(sum(changed) AS BIGINT) AS n_changed FROM per_value GROUP BY ALL
), found AS (
  SELECT {_KEYS}, scope, total, n_matched, coalesce(n_slots, 0) AS n_slots, coalesce(n_consistent, 0) AS n_consistent, coalesce(n_changed, 0) AS n_changed FROM held LEFT JOIN slots USING ({_KEYS}, scope)
)
SELECT doc_id, item_id, total AS n_windows, n_matched, n_slots, n_consistent, n_changed FROM found WHERE 2 * n_consistent >= n_slots
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY way, scope = 'all' DESC, n_matched DESC, n_consistent DESC, n_slots, n_changed, total DESC) = 1
"""
