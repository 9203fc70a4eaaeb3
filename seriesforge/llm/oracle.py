"""DuckDB SQL for the queries that SQL can express on whole tables.

The mixture's schedule is made in SQL as well: a recursive query fills one slot after the other.
"""

from . import mixing

#: Target weights of the mixture, in hundredths; the sources not named share the rest in equal parts.
WEIGHTS = {"src0": 20, "src1": 10, "src2": 10, "src3": 5, mixing.REST: 55}

#: A line of so many words is a run by itself.
LONG_LINE = 20

_NAMED = ", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items() if s != mixing.REST)

ORACLE: dict[str, str] = {
    "op8_line_dedup": f"""WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
n AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS t,
             row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn
      FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
w AS (SELECT a.doc_id, a.pos AS p1, b.pos AS p2,
             row_number() OVER (PARTITION BY a.t, b.t ORDER BY a.doc_id, a.pos) AS nth
      FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.rn = a.rn + 1),
long AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS nth
         FROM n WHERE len(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+')) >= {LONG_LINE}),
gone AS (SELECT doc_id, p1 AS pos FROM w WHERE nth > 1 UNION SELECT doc_id, p2 FROM w WHERE nth > 1
         UNION SELECT doc_id, pos FROM long WHERE nth > 1)
SELECT l.doc_id, COUNT(*) AS n_lines, COUNT(gone.pos) AS n_deleted,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id""",

    "op9_pfair_mix": f"""WITH RECURSIVE g AS (SELECT doc_id, coalesce(source, '{mixing.REST}') AS mix_source FROM documents),
there AS (SELECT d.mix_source, n.w FROM (SELECT DISTINCT mix_source FROM g) d LEFT JOIN (VALUES {_NAMED}) n(mix_source, w) USING (mix_source)),
part AS (SELECT greatest(COUNT(*) FILTER (WHERE w IS NULL), 1) AS m FROM there),
raw AS (SELECT mix_source, CAST(coalesce(w * m, {WEIGHTS[mixing.REST]}) AS BIGINT) AS w FROM there, part),
-- weights without a common divisor: the largest number that divides all of them
divisor AS (SELECT MAX(k) AS k FROM generate_series(1, (SELECT MIN(w) FROM raw)) t(k) WHERE (SELECT bool_and(w % k = 0) FROM raw)),
s AS (SELECT mix_source, w // k AS w, row_number() OVER (ORDER BY mix_source) AS i FROM raw, divisor),
l AS MATERIALIZED (SELECT list(w ORDER BY i) AS ws, CAST(SUM(w) AS BIGINT) AS d FROM s),
-- t slots are filled, done[i] of them by source i, the last one by pick: of the blocks released the earliest deadline, then the first name
edf AS (SELECT CAST(0 AS BIGINT) AS t, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, ws, d FROM l
        UNION ALL
        SELECT t + 1, list_transform(done, lambda x, i: CASE WHEN i = next THEN x + 1 ELSE x END), next, ws, d
        FROM (SELECT *, list_min(list_filter(list_transform(done, lambda x, i: CASE WHEN x < ws[i] AND x * d // ws[i] <= t
                           THEN ((x + 1) * d + ws[i] - 1) // ws[i] * 65536 + i END), lambda y: y IS NOT NULL)) % 65536 AS next
              FROM edf WHERE t < d)),
slots AS (SELECT s.mix_source, s.w, e.d, e.t - 1 AS slot_at, row_number() OVER (PARTITION BY e.pick ORDER BY e.t) - 1 AS k
          FROM edf e JOIN s ON e.pick = s.i),
r AS (SELECT *, row_number() OVER (PARTITION BY mix_source
                                   ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id) - 1 AS source_rank
      FROM g),
b AS (SELECT *, source_rank // {mixing.BLOCK_ROWS} AS block FROM r),
t AS (SELECT b.*, (b.block // x.w) * x.d + x.slot_at AS slot
      FROM b JOIN slots x ON b.mix_source = x.mix_source AND b.block % x.w = x.k)
SELECT doc_id, mix_source, source_rank, block, slot,
       slot * {mixing.BLOCK_ROWS} + source_rank % {mixing.BLOCK_ROWS} AS position FROM t""",
}
