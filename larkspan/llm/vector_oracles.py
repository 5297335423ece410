"""DuckDB SQL of the queries on embeddings."""

from larkspan.llm import hard_negatives, quantize


def _vectors(factor: int, also: str = "") -> str:
    kept = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"SELECT *, list_transform(embedding, lambda x: floor({factor}.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings WHERE {kept} {also}"


def _compression(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Each round is two tables: assignments a, then codebooks c of the next. Distances are whole numbers below 2^53, in doubles."""
    steps = [
        f"w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS k, * FROM ({_vectors(scale)}))",
        f"x AS MATERIALIZED (SELECT k, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM w, range({parts}) r(p))",
        f"c0 AS MATERIALIZED (SELECT p, k AS e, x AS c FROM x WHERE k < {entries})",
    ]
    for r in range(rounds + 1):
        far = "list_dot_product(c, c) - 2 * list_dot_product(x, c)"
        steps.append(f"a{r} AS MATERIALIZED (SELECT k, p, any_value(x) AS x, min(CAST({far} + list_dot_product(x, x) AS BIGINT) * {entries} + e) AS m FROM x JOIN c{r} USING (p) GROUP BY k, p)")
        if r < rounds:
            means = f"SELECT p, e, list(s ORDER BY i) AS c FROM (SELECT p, m % {entries} AS e, i, floor(sum(x[i]) / count(*)) AS s FROM a{r}, (SELECT unnest(range(1, len(v) // {parts} + 1)) AS i FROM (SELECT v FROM w LIMIT 1)) GROUP BY p, e, i) GROUP BY p, e"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN ({means}) n USING (p, e))")
    last = f"o AS (SELECT k, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY k)"
    book = f"SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(c) AS y, unnest(range(len(c))) AS i FROM c{rounds})"
    return f"WITH {', '.join([*steps, last])} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, ({book}) AS codebooks_sha256 FROM w JOIN o USING (k)"


def _negatives(factor: int, anchors: int, k: int) -> str:
    score = "CAST(list_dot_product(a.v, b.v) AS BIGINT)"
    return f"""WITH w AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({_vectors(factor, "AND label IS NOT NULL")})),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {score} AS score FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE a.vec_id % {anchors} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {k})
SELECT anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= {k}"""


ORACLE_SQL = {
    "op11_hard_negatives": _negatives(hard_negatives.FACTOR, hard_negatives.ANCHORS, hard_negatives.K),
    "op12_vector_compression": _compression(quantize.PARTS, quantize.ENTRIES, quantize.ROUNDS, quantize.SCALE),
}
