"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from . import neardup, secrets, substring, suffix
from .sharding import ROUND_A, ROUND_B, ROUND_P, ROUNDS

SPACE = r"[\x20\x09-\x0D]+"
#: A-Z alone are folded.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str, keep: str = "doc_id") -> str:
    """A row for each word: keep, i from 1, x."""
    return f"""SELECT {keep}, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM
  (SELECT {keep}, list_filter(string_split_regex({text}, '{SPACE}'), lambda x: x <> '') AS w FROM documents)"""


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS ({words(LOWER)}), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
g AS (SELECT doc_id, n, i, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {neardup.SHINGLE - 1} FOLLOWING) AS s FROM w JOIN n USING (doc_id)),
sh AS (SELECT DISTINCT doc_id, s FROM g WHERE i <= n - {neardup.SHINGLE - 1} OR (n < {neardup.SHINGLE} AND i = 1)), z AS (SELECT doc_id, count(*) AS z FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 75 * (x.z + y.z - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT r.a AS doc_id, CAST(coalesce(any_value(z), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, min(r.b) = r.a AS kept FROM r LEFT JOIN z ON z.doc_id = r.a GROUP BY r.a
"""

SUBSTRINGS = f"""
WITH w AS ({words("coalesce(text, '')")}),
g AS (SELECT *, string_agg(x, ' ') OVER f AS k, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {substring.WINDOW - 1} FOLLOWING)),
f AS (SELECT doc_id, i, x, n = {substring.WINDOW} AND min(CASE WHEN n = {substring.WINDOW} THEN doc_id END) OVER (PARTITION BY k) < doc_id AS hit FROM g),
c AS (SELECT doc_id, i, x, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {substring.WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM f)
SELECT d.doc_id, CAST(count(x) AS BIGINT) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""

SUFFIXES = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, h, CAST(length(h) / 2 AS BIGINT) AS n, unnest(range(0, CAST(length(h) / 2 AS BIGINT) // {suffix.LENGTH})) AS q FROM h),
s AS (SELECT doc_id, n, q, substr(h, {2 * suffix.LENGTH} * q + 1, {4 * suffix.LENGTH}) AS part FROM g),
k AS (SELECT doc_id, {suffix.LENGTH} * q + j AS i, md5(substr(part, 2 * j + 1, {2 * suffix.LENGTH})) AS k FROM s CROSS JOIN (SELECT unnest(range(0, {suffix.LENGTH})) AS j) WHERE {suffix.LENGTH} * q + j + {suffix.LENGTH} <= n),
f AS (SELECT doc_id, i FROM k SEMI JOIN (SELECT k FROM k GROUP BY 1 HAVING count(*) > 1) USING (k)),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {suffix.LENGTH} THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT doc_id, min(i) AS a, max(i) + {suffix.LENGTH} AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM b) GROUP BY doc_id, part),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
o AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front FROM q JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(concat(coalesce(front, ''), substr(h, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT))))) AS kept_sha256
FROM h LEFT JOIN o USING (doc_id)
"""


def crc_table() -> str:
    """The 256 steps of the reflected CRC-32 polynomial, as a list in SQL."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(str(i))
    return "[" + ", ".join(table) + "]"


def feistel_sql(x: str) -> str:
    """All rounds of one walk over x, halves of ``bits`` bits, as nested expressions of l and r columns."""
    left, right = f"({x} >> bits)", f"({x} & mask)"
    steps = [f"p0 AS (SELECT *, {left} AS l0, {right} AS r0 FROM src)"]
    for k in range(ROUNDS):
        affine = f"((r{k} % {ROUND_P}) * {ROUND_A} + {ROUND_B * (k + 1) + 42}) % {ROUND_P}"
        steps.append(f"q{k} AS (SELECT *, {affine} AS m{k} FROM p{k})")
        steps.append(f"p{k + 1} AS (SELECT *, r{k} AS l{k + 1}, xor(l{k}, ((m{k} * m{k} % {ROUND_P}) >> 5) & mask) AS r{k + 1} FROM q{k})")
    return ", ".join(steps)


#: Cycles are walked for all of the square domain at once: each place's next one, then the first below n.
SHARDS = f"""
WITH RECURSIVE c AS (SELECT {crc_table()} AS t),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a, b) & 255 + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM documents, c),
n AS (SELECT count(*) AS n FROM documents), h AS (SELECT n, CAST(greatest(1, ceil(log2(greatest(n, 1)) / 2)) AS BIGINT) AS bits FROM n), hm AS (SELECT *, (1::BIGINT << bits) - 1 AS mask FROM h),
src AS (SELECT *, unnest(range(0, 1::BIGINT << (2 * bits))) AS x FROM hm), {feistel_sql("x")},
nx AS (SELECT x, (l{ROUNDS} << bits) | r{ROUNDS} AS y, n FROM p{ROUNDS}),
walk AS (SELECT x, y FROM nx WHERE x < n UNION ALL SELECT walk.x, nx.y FROM walk JOIN nx ON nx.x = walk.y WHERE walk.y >= n),
place AS (SELECT walk.x, walk.y FROM walk, n WHERE walk.y < n),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS rn FROM d)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(y % 24 AS INTEGER) AS shard, CAST(y // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM r JOIN place ON place.x = rn
""".replace("t[xor(a, b) & 255 + 1]", "t[(xor(a, b) & 255) + 1]")


#: Of the rule itself: blank lines stay, equal lines go, lines of five words on also go if one word's edit makes them an earlier one.
LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line, n, list_filter(string_split_regex(line, '{SPACE}'), lambda x: x <> '') AS w FROM l),
k AS (SELECT doc_id, line, n, len(w) AS m, array_to_string(w, ' ') AS s, w FROM w),
u AS (SELECT s, any_value(w) AS w, any_value(m) AS m, min((doc_id, n)) AS first FROM k WHERE m > 0 GROUP BY s),
v AS (SELECT s, m, first, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM u, LATERAL (SELECT unnest(range(1, m + 1)) AS i) WHERE m >= 5),
near AS (SELECT s FROM (SELECT s, first, min(first) OVER (PARTITION BY v, i, m) AS low FROM v) WHERE low < first
  UNION SELECT v.s FROM v JOIN u ON u.s = v.v WHERE u.m >= 5 AND u.first < v.first UNION SELECT u.s FROM v JOIN u ON u.s = v.v WHERE u.m >= 5 AND v.first < u.first),
j AS (SELECT k.doc_id, k.n, k.line, k.m > 0 AND ((k.doc_id, k.n) <> u.first OR near.s IS NOT NULL) AS gone FROM k LEFT JOIN u ON u.s = k.s LEFT JOIN near ON near.s = k.s)
SELECT d.doc_id, CAST(count(j.n) AS BIGINT) AS n_lines, CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY d.doc_id
"""


def span_rows(kind: tuple, rank: int) -> str:
    """(doc_id, source, rank, a, z, v) of a kind's matches, from the pieces between them."""
    name, pattern, group, least = kind
    quoted = pattern.replace("'", "''")
    value = f"regexp_extract(m, '{quoted}', {group})" if group else "m"
    return f"""SELECT doc_id, source, {rank} AS rank, '{name}' AS kind, before + pre AS a, before + pre + length(m) AS z, {value} AS v FROM
  (SELECT *, coalesce(sum(pre + length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
    (SELECT doc_id, source, unnest(ms) AS m, generate_subscripts(ms, 1) AS i, length(unnest(string_split_regex(text, '{quoted}')[1:len(ms)])) AS pre FROM
      (SELECT doc_id, source, text, regexp_extract_all(text, '{quoted}', 0) AS ms FROM documents WHERE text IS NOT NULL) WHERE len(ms) > 0))
  WHERE length({value}) >= {least}"""


_TEXT = "kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(z AS VARCHAR)"
SECRETS = f"""
WITH base AS ({" UNION ALL ".join(span_rows(k, i) for i, k in enumerate(secrets.BASE))}), gen AS ({span_rows(secrets.GENERIC, len(secrets.BASE))}),
extra AS (SELECT * FROM gen g WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = g.doc_id AND b.a < g.z AND g.a < b.z)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
own AS (SELECT v, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT (doc_id, coalesce(source, ''))) AS holdings, count(DISTINCT doc_id) AS places FROM every GROUP BY v),
j AS (SELECT every.*, owners <= 2 AND places <= 20 AS live, holdings FROM every JOIN own USING (v) WHERE (owners <= 2 AND places <= 20) OR rank < {len(secrets.BASE)}),
b AS (SELECT doc_id, sum(CASE WHEN rank = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN rank = 2 THEN 1 ELSE 0 END) AS n2, string_agg({_TEXT}, ',' ORDER BY a, rank, z) AS s FROM base GROUP BY 1),
t AS (SELECT doc_id, string_agg({_TEXT}, ',' ORDER BY a, rank, z) AS s, sum(CASE WHEN live THEN 1 ELSE 0 END) AS live, sum(CASE WHEN live THEN 0 ELSE 1 END) AS copied, max(holdings) AS most FROM j GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256,
  coalesce(t.s, '') AS spans, CAST(coalesce(live, 0) AS BIGINT) AS n_live, CAST(coalesce(copied, 0) AS BIGINT) AS n_copied, CAST(coalesce(most, 0) AS BIGINT) AS most_holdings
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

ORACLES = {
    "op1_minhash_components": NEAR_DUPLICATES, "op2_substring_repeats": SUBSTRINGS, "op4_feistel_shards": SHARDS,
    "op8_suffix_repeats": SUFFIXES, "op9_secret_ownership": SECRETS, "op10_line_dedup": LINES,
}
