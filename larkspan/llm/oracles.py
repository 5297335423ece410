"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from larkspan.llm import decontam, mixing, pii, secrets

_ESC = r"replace(replace(replace({0}, '\', '\s'), '###', '\h'), '</turn>', '\t')"
CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, {_ESC.format("text")} AS x, replace({_ESC.format("role")}, ':', '\c') AS r,
    row_number() OVER w AS k, lag(role) OVER w AS prev
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x) + 7 + CASE WHEN k = 1 THEN 6 + length(r) WHEN role <> prev THEN 7 + length(r) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

#: The checksum goes bit by bit over the bytes, which are read from hexadecimal digits.
SHARDING = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    md5(coalesce(text, '')) AS th, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ih FROM documents
), table_ AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), texts AS (
  SELECT th, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM (SELECT DISTINCT th, text FROM d)
), sums AS (
  SELECT th, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS crc FROM texts, table_
), p AS (
  SELECT *, sum(size) OVER w - size AS before, row_number() OVER w - 1 AS rank, sum(size) OVER () AS whole
  FROM d WINDOW w AS (ORDER BY th, ih, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)
), q AS (SELECT *, least(23, (2 * before + size) * 24 // greatest(2 * whole, 1)) AS shard0 FROM p),
g AS (
  SELECT th, least(23, (2 * min(before) + sum(size)) * 24 // greatest(2 * any_value(whole), 1)) AS to_
  FROM q GROUP BY th HAVING min(shard0) < max(shard0) AND sum(size) * 24 <= 0.02 * any_value(whole)
), r AS (SELECT q.*, coalesce(to_, shard0) AS s FROM q LEFT JOIN g USING (th))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(s AS INTEGER) AS shard,
  CAST(rank - min(rank) OVER (PARTITION BY s) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN sums USING (th, text)"""

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, md5(coalesce(text, '')) AS th FROM documents
), s AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), w AS (
  SELECT *, CAST({list(mixing.WEIGHTS)}[1 + nth % 3] AS DOUBLE) AS weight, CAST({list(mixing.SLOPES)}[1 + nth % 3] AS DOUBLE) AS slope, source_size * 2.0::DOUBLE AS cap,
    sum(source_size) OVER () * 1.5::DOUBLE AS all_ FROM s
), f AS (
  SELECT *, (all_ - coalesce(sum(cap) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * weight >= cap AS full_
  FROM w WINDOW x AS (ORDER BY cap / weight, source NULLS LAST)
), t AS (
  SELECT *, CASE WHEN full_ THEN cap ELSE weight * (all_ - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () END AS target FROM f
), p AS (
  SELECT d.*, source_size, target, slope, CAST(floor(target + 0.5) AS BIGINT) AS goal,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, th ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT p.*, e, greatest(0, least(size, goal - e * source_size - before)) AS words
  FROM p, LATERAL (SELECT unnest(range(greatest(1, CAST(ceil(goal / greatest(source_size, 1)) AS BIGINT)))) AS e)
), z AS (
  SELECT *, (e * source_size + before + words / 2) / CASE WHEN goal > 0 THEN goal ELSE 1 END AS share, 1 - slope AS down FROM e
), y AS (SELECT *, least(1.0, 2 * share / CASE WHEN share > 0 THEN down + sqrt(down * down + 4 * slope * share) ELSE 1 END) AS position FROM z)
SELECT doc_id, size, source_size, target, CAST(sum(words) AS BIGINT) AS taken, CAST(count(*) FILTER (words > 0) AS INTEGER) AS n_passes,
  round(min(position) FILTER (words > 0), 9) AS first_position
FROM y GROUP BY doc_id, size, source_size, target, key, th, before"""


def _masked(mask: str) -> str:
    return " || ' ' || ".join(f"t[pos + {k}]" for k, c in enumerate(mask) if c == "1")


_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
_SEEDS = " UNION ALL ".join(f"SELECT id, pos, {n} AS m, {_masked(m)} AS h FROM {{0}} WHERE pos + {len(m) - 1} <= len(t)" for n, m in enumerate(decontam.MASKS))
_LONGEST = max(map(len, decontam.MASKS))
#: Diagonals of long items come from equal masks, those of short ones from any equal token; places are counted from 1.
DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_TOKENS} AS t FROM documents),
b AS (SELECT row_number() OVER () AS id, item_id, {_TOKENS} AS t FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT * FROM b WHERE len(t) >= {decontam.MIN_TOKENS}),
dp AS (SELECT id, t, unnest(range(1, len(t) + 1)) AS pos FROM d),
ip AS (SELECT id, t, unnest(range(1, len(t) + 1)) AS pos FROM i),
ds AS ({_SEEDS.format("dp")}),
js AS ({_SEEDS.format("(SELECT * FROM ip WHERE len(t) >= " + str(_LONGEST) + ")")}),
g AS (
  SELECT DISTINCT ds.id AS doc, js.id AS item, ds.pos - js.pos AS diagonal FROM ds JOIN js USING (m, h)
  UNION SELECT dp.id, ip.id, dp.pos - ip.pos FROM dp JOIN ip ON dp.t[dp.pos] = ip.t[ip.pos] AND len(ip.t) < {_LONGEST}
),
a AS (
  SELECT doc, item, diagonal, len(i.t) AS n, list_filter(range(1, len(i.t) + 1), lambda k: k + diagonal >= 1 AND d.t[k + diagonal] = i.t[k]) AS places
  FROM g JOIN d ON d.id = doc JOIN i ON i.id = item
),
w AS (
  SELECT doc, item, n, CAST(len(list_distinct(flatten(list(places)))) AS BIGINT) AS matched, min(greatest(diagonal, 0)) AS doc_start
  FROM a WHERE n >= {_LONGEST} OR len(places) >= 0.6 * n GROUP BY doc, item, n
),
r AS (
  SELECT doc_id, item_id, matched, CAST(n AS BIGINT) AS item_tokens, round(matched / n, 6) AS overlap, CAST(doc_start AS BIGINT) AS doc_start,
    row_number() OVER (PARTITION BY doc_id, item_id, n ORDER BY matched DESC, doc_start) AS k
  FROM w JOIN d ON d.id = doc JOIN i ON i.id = item WHERE matched >= 0.6 * n
)
SELECT * EXCLUDE (k) FROM r WHERE k = 1"""

_WORD = "[A-Za-z0-9+/]"
#: kind: pattern, what else a match has to be, role. Patterns of the same matches without assertions, which the engine lacks.
_SECRETS = {
    "assign": (secrets.ASSIGN, f"length(regexp_extract(v, p, 2)) >= {secrets.BASE['assign'][2]}", "secret"),
    "access": (secrets.ACCESS, f"length(v) >= {secrets.BASE['access'][2]}", "identifier"),
    "hex": (secrets.HEX, f"length(v) >= {secrets.BASE['hex'][2]}", "secret"),
    "weak_identifier": (secrets.WEAK["weak_identifier"][0], "true", "identifier"),
    "weak_secret": (f"{_WORD}{{20,}}", "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')", "secret"),
    "endpoint": (secrets.WEAK["endpoint"][0].replace("++", "+"), "true", "endpoint"),
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found(kinds: dict) -> str:
    """id, rank, kind, role, v, start_, end_ of the matches in the texts of d: what lies between them gives offsets."""
    return " UNION ALL ".join(
        f"""SELECT id, {n} AS rank, '{kind}' AS kind, '{role}' AS role, v, before + v_before AS start_, before + v_before + length(v) AS end_ FROM (
  SELECT id, v, p, list_sum(list_transform(gaps[1:nth], lambda x: length(x))) AS before, coalesce(list_sum(list_transform(vs[1:nth - 1], lambda x: length(x))), 0) AS v_before
  FROM (SELECT id, p, vs, gaps, unnest(vs) AS v, unnest(range(1, len(vs) + 1)) AS nth FROM (
    SELECT id, {_quoted(p)} AS p, regexp_extract_all(text, {_quoted(p)}) AS vs, string_split_regex(text, {_quoted(p)}) AS gaps FROM d))
) WHERE {test}"""
        for n, (kind, (p, test, role)) in enumerate(kinds.items())
    )


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_found(_SECRETS)}),
b AS (SELECT * FROM f WHERE rank < 3),
w AS (SELECT * FROM f WHERE rank >= 3 AND NOT EXISTS (SELECT 1 FROM b WHERE b.id = f.id AND b.start_ < f.end_ AND f.start_ < b.end_)),
o AS (SELECT * FROM b UNION ALL SELECT * FROM w),
n AS (
  SELECT w.id, w.rank, w.kind, w.start_, w.end_, w.role, bool_or(o.role = 'identifier') AS i, bool_or(o.role = 'secret') AS s
  FROM w JOIN o ON o.id = w.id AND o.role <> w.role AND greatest(o.start_ - w.end_, w.start_ - o.end_) <= 200 GROUP BY ALL
),
c AS (SELECT id, rank, kind, start_, end_ FROM n WHERE CASE role WHEN 'identifier' THEN s WHEN 'secret' THEN i ELSE s AND i END),
x AS (SELECT id, rank, kind, start_, end_ FROM b UNION ALL SELECT * FROM c),
y AS (
  SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', CAST(start_ AS BIGINT), ':', CAST(end_ AS BIGINT)), ',' ORDER BY start_, rank, end_) FILTER (rank < 3) AS base,
    string_agg(concat(kind, ':', CAST(start_ AS BIGINT), ':', CAST(end_ AS BIGINT)), ',' ORDER BY start_, rank, end_) AS spans
  FROM x GROUP BY id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN y USING (id)"""

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[-i] AS INT) "
    f"ELSE 2 * CAST({_DIGITS}[-i] AS INT) - CASE WHEN CAST({_DIGITS}[-i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
)
_PERSONAL = {
    "email": (pii.EMAIL, "true", ""),
    "ip": (pii.IP, "list_bool_and(list_transform(string_split(v, '.'), lambda x: CAST(x AS HUGEINT) <= 255))", ""),
    "card": (pii.CARD, f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END", ""),
    "phone": (pii.PHONE, f"length({_DIGITS}) BETWEEN 10 AND 15", ""),
}
PERSONAL_DATA = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, count(*) OVER () AS n FROM documents),
b AS ({_found(_PERSONAL)}),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
m AS (SELECT DISTINCT id, kind || ':' || CASE WHEN kind = 'email' THEN lower(v) ELSE {_DIGITS} END AS entity FROM b),
e AS (SELECT entity, df_e, df_e * (1 + 1 / n) * pow(n / df_e, 0.3) - 1 + 1e-6 AS most FROM (SELECT entity, count(*) AS df_e FROM m GROUP BY entity), n),
me AS (SELECT * FROM m JOIN e USING (entity)),
reach AS (SELECT id, max(most) AS most FROM me GROUP BY id),
df AS (SELECT term, count(*) AS df_t FROM (SELECT id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM d) GROUP BY term),
held AS (SELECT * FROM d WHERE id IN (SELECT id FROM b)),
w AS ({_found({"term": (pii.TERM, "true", "")}).replace("FROM d)", "FROM held)")}),
said AS (
  SELECT w.id, lower(v) AS term, start_, end_, df_t FROM w JOIN df ON df.term = lower(v) JOIN reach ON reach.id = w.id AND df_t <= most
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = w.id AND b.start_ < w.end_ AND w.start_ < b.end_)
),
pairs AS (SELECT s.id, entity, df_e, term, df_t FROM (SELECT DISTINCT id, term, df_t FROM said) s JOIN me ON me.id = s.id AND df_t <= most),
rated AS (
  SELECT entity, term, CASE WHEN ln(n / df_e) > 0 THEN 1 + ln((df_te + df_e / n) / (df_t + 1)) / ln(n / df_e) ELSE 0 END AS ratio
  FROM (SELECT entity, df_e, term, df_t, count(*) AS df_te FROM pairs GROUP BY ALL), n
),
best AS (SELECT id, term, max(ratio) AS ratio FROM pairs JOIN (SELECT * FROM rated WHERE ratio >= 0.7) USING (entity, term) GROUP BY id, term),
x AS (
  SELECT id, rank, kind, start_, end_ FROM b
  UNION ALL SELECT id, 4, CASE WHEN ratio >= 0.9 THEN 'term_removed' ELSE 'term_generalised' END, start_, end_ FROM said JOIN best USING (id, term)
),
y AS (
  SELECT id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)},
    string_agg(concat(kind, ':', CAST(start_ AS BIGINT), ':', CAST(end_ AS BIGINT)), ',' ORDER BY start_, rank, end_) FILTER (rank < 4) AS base,
    string_agg(concat(kind, ':', CAST(start_ AS BIGINT), ':', CAST(end_ AS BIGINT)), ',' ORDER BY start_, rank, end_) AS spans
  FROM x GROUP BY id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN y USING (id)"""

ORACLE_SQL = {
    "op2_secret_scan": SECRETS,
    "op3_source_mixing": MIXING,
    "op5_sharding": SHARDING,
    "op7_pii": PERSONAL_DATA,
    "op8_decontamination": DECONTAMINATION,
    "op10_chat_formatting": CHAT,
}
