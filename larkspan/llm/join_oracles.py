"""DuckDB SQL of the similarity joins of texts: every pair that shares a shingle, and components by recursion."""

from larkspan.llm import chosen_path


def similarity_sql(n: int, percent: int, kept: bool) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
t AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [md5(array_to_string(w, ' '))]
  ELSE list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) END AS s FROM w),
e AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS g FROM t),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM e a JOIN e b USING (g) WHERE a.r <> b.r AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.r, b.r HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
c AS (SELECT r AS a, r AS c FROM t UNION SELECT l.b AS a, c.c FROM c JOIN l ON c.a = l.a)
SELECT t.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m AS component_id{", coalesce(t.doc_id = m, false) AS kept" if kept else ""}
FROM t JOIN (SELECT c.a AS r, min(t.doc_id) AS m FROM c JOIN t ON t.r = c.c GROUP BY c.a) USING (r)"""


ORACLE_SQL = {
    "op9_ngram_jaccard": similarity_sql(4, 85, False),
    "op13_minhash_dedup": similarity_sql(chosen_path.WORDS, chosen_path.PERCENT, True),
}
