"""DuckDB SQL of the operators on vectors."""

from __future__ import annotations

_INTS = """usable AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ints AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM usable)"""

TOP = f"""WITH {_INTS}, scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds one after the other: pairs of pieces and entries, the nearest of each, and the entries' new components."""
    out = [
        f"""pieces AS MATERIALIZED (SELECT vec_id, label, p, CAST(v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS DOUBLE[]) AS x FROM ints, range({parts}) r(p))""",
        f"""book0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x AS c FROM pieces WHERE vec_id IN (SELECT vec_id FROM ints ORDER BY vec_id LIMIT {entries}))""",
    ]
    for k in range(rounds + 1):
        out.append(f"""near{k} AS MATERIALIZED (SELECT vec_id, label, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (
  SELECT vec_id, label, s.p, x, e, CAST(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS BIGINT) AS d FROM pieces s JOIN book{k} b ON s.p = b.p) GROUP BY vec_id, label, p)""")
        if k < rounds:
            out.append(f"""cell{k} AS (SELECT p, best.e AS e, i, CAST(floor(sum(CAST(x[i] AS BIGINT)) / count(*)) AS DOUBLE) AS y FROM near{k}, range(1, 1 + (SELECT max(len(x)) FROM pieces)) r(i) GROUP BY p, best.e, i),
mean{k} AS (SELECT p, e, list(y ORDER BY i) AS c FROM cell{k} GROUP BY p, e), book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)""")
    out.append(f"""codes AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})""")
    return f"WITH {_INTS}, {', '.join(out)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, digest"


CODES = _codes()
