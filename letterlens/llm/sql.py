"""DuckDB SQL for the registered queries of this subpackage, where SQL can express them."""

OP1 = r"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

OP10 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 16) AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid
  FROM sized GROUP BY source),
w AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CAST(2 * source_size AS DOUBLE) AS ceiling
  FROM src),
-- Reshare by weight until no source is above its ceiling.
fill(round, sid, full_, level, done) AS (
  SELECT 0, sid, false, CAST(NULL AS DOUBLE), false FROM w
  UNION ALL
  SELECT round + 1, f.sid, f.full_ OR w.weight * l.level > w.ceiling, l.level,
         NOT bool_or(NOT f.full_ AND w.weight * l.level > w.ceiling) OVER ()
  FROM fill f JOIN w USING (sid),
       (SELECT (1.5 * (SELECT sum(source_size) FROM w) - coalesce(sum(w.ceiling) FILTER (f.full_), 0))
               / nullif(sum(w.weight) FILTER (NOT f.full_), 0) AS level FROM fill f JOIN w USING (sid)) l
  WHERE NOT f.done),
lvl AS (SELECT * FROM fill WHERE round = (SELECT max(round) FROM fill)),
tg AS (
  SELECT w.*, CASE WHEN full_ THEN ceiling ELSE least(ceiling, weight * level) END AS target
  FROM w JOIN lvl USING (sid)),
b AS (
  SELECT *, CAST(round(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM tg),
s AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         sum(d.size) OVER (PARTITION BY b.sid ORDER BY d.key ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM sized d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * epochs + greatest(0, least(size, rest - start)) AS BIGINT) AS taken
FROM s
"""

OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[\\#<]')) + length(role) + len(regexp_extract_all(role, '[\\#<:]')) + 15 AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP6 = r"""
WITH v AS (
  SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
"""

#: Levels that the SQL of the Merkle tree has: up to 16**SOURCE_LEVELS rows a source and 16**TOP_LEVELS sources.
SOURCE_LEVELS, TOP_LEVELS = 7, 4


def merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))"
    crc = (f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {digits}), "
           "lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")

    def level(name: str, before: str, key: str, k: int) -> str:
        """Each node of `before` with what stands left and right of it in its run, and the nodes above."""
        run = f"PARTITION BY {key}, idx // 16 ORDER BY idx"
        return f"""
{name}_s{k} AS (
  SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS lefts,
         coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights FROM {before}),
{name}_{k + 1} AS (
  SELECT {key}, idx // 16 AS idx, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE any_value(d) END AS d
  FROM {before} GROUP BY {key}, idx // 16),"""

    out = f"""WITH leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS src, {leaf('text')} AS d, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS folded FROM documents),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, d) - 1 AS idx, count(*) OVER (PARTITION BY src) AS n FROM leaves),
l_0 AS (SELECT src, idx, n, d FROM rows_),"""
    out += "".join(level("l", f"l_{k}", "src", k) for k in range(SOURCE_LEVELS))
    out += f"""
t_0 AS (SELECT 0 AS g, src, row_number() OVER (ORDER BY src) - 1 AS idx, count(*) OVER () AS n, d FROM l_{SOURCE_LEVELS}),"""
    out += "".join(level("t", f"t_{k}", "g", k) for k in range(TOP_LEVELS))
    out += f"""
f_0 AS (SELECT doc_id, src, idx, d AS leaf, folded, '' AS proof FROM rows_),"""
    for k in range(SOURCE_LEVELS):
        out += f"""
f_{k + 1} AS (
  SELECT f.* REPLACE (f.idx // 16 AS idx, CASE WHEN s.lefts IS NULL THEN folded ELSE sha256(s.lefts || folded || s.rights) END AS folded, CASE WHEN s.lefts IS NULL THEN proof ELSE proof || s.lefts || s.rights END AS proof)
  FROM f_{k} f JOIN l_s{k} s ON s.src = f.src AND s.idx = f.idx),"""
    out += f"""
g_0 AS (SELECT f.* REPLACE (t.idx AS idx), t.d AS subroot FROM f_{SOURCE_LEVELS} f JOIN t_0 t ON t.src = f.src),"""
    for k in range(TOP_LEVELS):
        out += f"""
g_{k + 1} AS (
  SELECT f.* REPLACE (f.idx // 16 AS idx, CASE WHEN s.lefts IS NULL THEN folded ELSE sha256(s.lefts || folded || s.rights) END AS folded, CASE WHEN s.lefts IS NULL THEN proof ELSE proof || s.lefts || s.rights END AS proof)
  FROM g_{k} f JOIN t_s{k} s ON s.idx = f.idx),"""
    return out[:-1] + f"""
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.d AS verified FROM g_{TOP_LEVELS}, t_{TOP_LEVELS} r
"""


ORACLES = {
    "op1_exact_dedup": OP1,
    "op2_chat_format": OP2,
    "op6_exact_topk": OP6,
    "op10_mixing": OP10,
    "op12_merkle_manifest": merkle_sql(),
}
