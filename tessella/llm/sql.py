"""DuckDB SQL of the operators that it can express on whole tables."""

#: crc32 of the decimal digits of a number, bit by bit: eight shifts for every character.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384::BIGINT) ELSE xor(a, b) >> 1 END), 4294967295::BIGINT)"

TRIE = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n, {_CRC.format("conv_id")} % 6 AS h FROM t GROUP BY conv_id),
s AS (SELECT c.conv_id, t.place AS depth, role, text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h UNION ALL
  SELECT c.conv_id, t.place - c.h + least(c.h, coalesce(b.n, 0)), role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h LEFT JOIN c b ON b.conv_id = c.base),
w AS (SELECT conv_id, depth, string_agg(md5(len(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, len(text) AS chars, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM s
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM s) FROM c),
n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM w GROUP BY key, depth),
k AS (SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
x AS (SELECT a.key, sum((b.n_children = 0)::BIGINT) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved_tokens FROM f a JOIN f b ON starts_with(b.key, a.key) GROUP BY a.key)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN x USING (key) LEFT JOIN f p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.key = left(f.key, 32 * (f.depth - 1))"""

_VECTORS = "SELECT vec_id, label, list_transform(embedding, lambda x: floor({0} * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOPK = f"""WITH v AS ({_VECTORS.format(64)} AND vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


def _codes() -> str:
    d = "list_inner_product(v.part, v.part) + list_inner_product(b.part, b.part) - 2 * list_inner_product(v.part, b.part)"
    steps = [
        f"e AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, * FROM ({_VECTORS.format(256)}))",
        "v AS (SELECT row, vec_id, label, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS part FROM e, range(16) r(p))",
        "b0 AS (SELECT p, row - 1 AS k, part FROM v WHERE row <= 64)",
    ]
    for r in range(3):
        steps.append(f"a{r} AS (SELECT row, v.p, min(({d})::BIGINT * 64 + k) AS best FROM v JOIN b{r} b ON v.p = b.p GROUP BY row, v.p)")
        if r < 2:
            steps.append(f"m{r} AS (SELECT p, k, list(m ORDER BY i) AS part FROM (SELECT p, k, i, floor(sum(y) / count(*)) AS m FROM (SELECT v.p, best % 64 AS k, unnest(part) AS y, generate_subscripts(part, 1) AS i FROM v JOIN a{r} a ON a.row = v.row AND a.p = v.p) GROUP BY p, k, i) GROUP BY p, k)")
            steps.append(f"b{r + 1} AS (SELECT b.p, b.k, coalesce(m.part, b.part) AS part FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.k = b.k)")
    steps.append("c AS (SELECT row, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY row)")
    return f"WITH {', '.join(s.replace(' AS (', ' AS MATERIALIZED (', 1) for s in steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(list_transform(part, lambda y: y::BIGINT), ','), ',' ORDER BY p, k)) FROM b2) AS codebooks_sha256 FROM c JOIN e USING (row)"


CODES = _codes()
