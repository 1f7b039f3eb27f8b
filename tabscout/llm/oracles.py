"""SQL that DuckDB runs for the queries that SQL can express."""
from __future__ import annotations

from tabscout.llm import decontaminate, linejoin, mixing
from tabscout.plans.registry import sql_h

_LOWER = "translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _apportion(name: str, source: str, parent: str, child: str) -> str:
    """CTEs ending in ``name``: Sainte-Lague over source(parent, child, weight, seats, cap) as quota."""
    return f"""
{name}_base AS (
  SELECT *, sum(weight) OVER p AS total, count(*) OVER p AS n,
    least(cap, CASE WHEN sum(weight) OVER p > 0 THEN floor(weight * seats / sum(weight) OVER p + 0.5) ELSE 0 END::BIGINT) AS base
  FROM {source} WINDOW p AS (PARTITION BY {parent})),
{name}_short AS (SELECT *, (seats - sum(base) OVER (PARTITION BY {parent}))::BIGINT AS short FROM {name}_base),
{name}_room AS (
  SELECT *, sum(eligible) OVER (PARTITION BY {parent}) AS open_weight
  FROM (SELECT *, CASE WHEN short > 0 AND cap <= base THEN 0.0 ELSE weight END::DOUBLE AS eligible FROM {name}_short)),
{name}_shared AS (SELECT *, ceil(eligible / nullif(open_weight, 0) * 1.5 * n)::BIGINT + 2 AS share FROM {name}_room),
{name}_offer AS (
  SELECT *, CASE WHEN short > 0 THEN base + j ELSE base - 1 - j END AS seat
  FROM (SELECT *, unnest(range(CASE WHEN short <> 0 AND open_weight > 0 THEN
    CASE WHEN short > 0 THEN greatest(least(share, cap - base), 1) ELSE share END ELSE 1 END)) AS j FROM {name}_shared)),
{name}_free AS (SELECT *, seat >= 0 AND (short <= 0 OR seat < cap) AS free FROM {name}_offer),
{name}_rank AS (
  SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY NOT free,
    CASE WHEN short > 0 THEN -(weight / (2 * seat + 1)) ELSE weight / (2 * seat + 1) END, {child}) AS place FROM {name}_free),
{name} AS (
  SELECT {parent}, {child}, (any_value(base) + sign(any_value(short)) * count(CASE WHEN place <= abs(short) AND free THEN 1 END))::BIGINT AS quota
  FROM {name}_rank GROUP BY {parent}, {child})"""


_SEED = f"'{mixing.SEED}'"
_WEIGHTS = ", ".join(map(str, mixing.WEIGHTS))
_UP, _DOWN = mixing.SHARE
MIXING = f"""WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS key, {sql_h('text')} AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, key, sum(size)::BIGINT AS source_size, count(*) AS docs,
    [{_WEIGHTS}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}]::BIGINT AS w FROM sized GROUP BY 1, 2),
filling AS (
  SELECT *, {_UP} * sum(source_size) OVER () - {_DOWN * mixing.MOST} * coalesce(sum(source_size) OVER f, 0) AS remaining,
    sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS rest FROM sources
  WINDOW f AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, {_DOWN * mixing.MOST} * source_size * rest <= w * remaining AS is_full FROM filling),
opened AS (SELECT rest AS open_rest, remaining AS open_left FROM filled WHERE NOT is_full ORDER BY rest DESC LIMIT 1),
targets AS (
  SELECT key, source_size, ceil((source_size + docs) / {mixing.SHARD_WORDS})::BIGINT AS shards,
    CASE WHEN is_full THEN ({mixing.MOST} * source_size)::DOUBLE ELSE (w * open_left)::DOUBLE / ({_DOWN} * open_rest)::DOUBLE END AS target
  FROM filled LEFT JOIN opened ON true),
placed AS (
  SELECT doc_id, key, size, source_size, target, ord, ord % shards AS shard
  FROM (SELECT *, {sql_h(_SEED, 'doc_id', 'key', 'digest')} AS ord FROM sized) JOIN targets USING (key)),
shards AS (SELECT key, shard, sum(size)::BIGINT AS words, ceil(sum(size) / {mixing.BLOCK_WORDS})::BIGINT AS blocks
  FROM placed GROUP BY 1, 2 HAVING sum(size) > 0),
weighed AS (SELECT 0 AS everything, key, target * sum(blocks) / source_size AS weight, {mixing.MOST} * sum(blocks)::BIGINT AS cap FROM shards JOIN targets USING (key) GROUP BY key, target, source_size),
seated AS (SELECT *, floor(sum(weight) OVER () + 0.5)::BIGINT AS seats FROM weighed),
{_apportion('by_source', 'seated', 'everything', 'key')},
shard_seats AS (SELECT key, shard, blocks AS weight, quota AS seats, {mixing.MOST} * blocks AS cap FROM shards JOIN by_source USING (key)),
{_apportion('by_shard', 'shard_seats', 'key', 'shard')},
plan AS (
  SELECT key, shard, words, blocks, quota // blocks AS times, quota % blocks AS more, {sql_h(_SEED, "'first'", 'key', 'shard')} % blocks AS first_block
  FROM shards JOIN by_shard USING (key, shard)),
lying AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY key, shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM placed WHERE size > 0),
cut AS (
  SELECT *, first_block * words // blocks AS a, least(first_block + more, blocks) * words // blocks AS b,
    greatest(first_block + more - blocks, 0) * words // blocks AS c FROM lying JOIN plan USING (key, shard))
SELECT doc_id, size, source_size, target, (times * size + greatest(0, least(size, c - start))
  + greatest(0, least(size, b - start)) - greatest(0, least(size, a - start)))::BIGINT AS taken FROM cut
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM placed WHERE size = 0"""

_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS.format(x='text')} AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS.format(x='text')} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(words[i + 1:i + least({decontaminate.WINDOW}, len(words))], ' ') AS win, least({decontaminate.WINDOW}, len(words)) AS n
  FROM (SELECT *, unnest(range(greatest(1, len(words) - {decontaminate.WINDOW - 1}))) AS i FROM b WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT row, n, i, array_to_string(words[i + 1:i + n], ' ') AS win
  FROM (SELECT row, words, n, unnest(range(len(words) - n + 1)) AS i FROM d, lengths WHERE len(words) >= n)),
hits AS (SELECT row, i, n, item FROM places JOIN windows USING (win, n)),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
found AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN covered USING (row) LEFT JOIN found USING (row)"""

LINE_JOIN = f"""WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
sets AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) AS words
  FROM lines),
classes AS (
  SELECT words, len(words) AS n, min({{'d': coalesce(doc_id, {linejoin.LAST}), 'l': line_no}}) AS first FROM sets WHERE len(words) > 0 GROUP BY words),
each AS (SELECT first, n, unnest(words) AS word FROM classes),
rare AS (SELECT word, count(*) AS f FROM each GROUP BY 1),
placed AS (SELECT first, word, n, row_number() OVER (PARTITION BY first ORDER BY f, word) AS place FROM each JOIN rare USING (word)),
postings AS (SELECT first, word, n FROM placed WHERE place <= n - ceil(n * 0.8 - 1e-9) + 1),
pairs AS (SELECT DISTINCT a.first AS a, b.first AS b FROM postings a JOIN postings b ON a.word = b.word AND a.first < b.first
  AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
gone AS (
  SELECT DISTINCT p.b AS first FROM pairs p JOIN classes x ON x.first = p.a JOIN classes y ON y.first = p.b
  WHERE len(list_intersect(x.words, y.words)) * 9 >= 4 * (x.n + y.n)),
told AS (
  SELECT s.doc_id, s.line_no, c.first IS NOT NULL AND (g.first IS NOT NULL OR c.first <> {{'d': coalesce(s.doc_id, {linejoin.LAST}), 'l': s.line_no}}) AS gone
  FROM sets s LEFT JOIN classes c USING (words) LEFT JOIN gone g ON g.first = c.first)
SELECT doc_id, count(line_no) AS n_lines, count(CASE WHEN gone THEN 1 END) AS n_removed,
  coalesce(string_agg(CASE WHEN gone THEN line_no::VARCHAR END, ',' ORDER BY line_no), '') AS removed
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN told USING (doc_id) GROUP BY doc_id"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT),
      lambda c, b: list_reduce(range(8), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
      4294967295::BIGINT))"""


def _edit(state: str, letter: str, cost: str, line: str | None = None) -> str:
    """``state`` = {c: cost, a: audit, r: repaired} after one more edit; null stays null."""
    put = f"{state}.r || CASE WHEN {state}.r = '' THEN '' ELSE chr(10) END || {line}" if line else f"{state}.r"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {put}}} END"


def _with_inserts(source: str, keys: str) -> str:
    """SELECT of ``source`` with the states that inserted rows reach."""
    u = ", ".join(_edit(x, "I", "2", "'user:'") for x in "zsa")
    a = _edit("u1", "I", "2", "'assistant:'")
    return f"SELECT {keys}, z, s, u1 AS u, least(a, {a}) AS a FROM (SELECT *, least(u, {u}) AS u1 FROM {source})"


def _after_row() -> str:
    """The four states after one row, from those before it."""
    gone = lambda x: _edit(x, "D", "3")
    keep = lambda x, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_edit(x, 'K', 'cut', 'line')} END"
    change = lambda x, role: f"CASE WHEN NOT gone THEN {_edit(x, 'R', '2 + cut', f"'{role}:' || text")} END"
    into_u = [keep(x, "u") for x in "zsa"] + [change(x, "user") for x in "zsa"]
    return f"""{gone('z')} AS z, least({gone('s')}, {keep('z', 's')}) AS s, least({gone('u')}, {', '.join(into_u)}) AS u,
      least({gone('a')}, {keep('u', 'a')}, {change('u', 'assistant')}) AS a"""


_START = "{'c': 0::BIGINT, 'a': '', 'r': ''}"

# Damage and faults, then the cheapest and least audit row by row for each state: nothing yet (z), after
# system (s), user (u) and assistant (a).
REPAIR = rf"""WITH RECURSIVE keyed AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {_crc32('k')} % 20 AS kind FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt),
faults AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, role || ':' || text AS line,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') AS open_end,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
marked AS (
  SELECT *, blank OR again AS gone, (NOT blank AND NOT again AND open_end)::INTEGER AS cut FROM faults),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut)::BIGINT AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM marked GROUP BY 1),
walk AS (
  SELECT conv_id, 0::BIGINT AS done, {_START} AS z, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS s,
    {_edit(_START, 'I', '2', "'user:'")} AS u, {_edit(_edit(_START, 'I', '2', "'user:'").join('()'), 'I', '2', "'assistant:'")} AS a FROM counts
  UNION ALL
  {_with_inserts(f"(SELECT w.conv_id, m.i AS done, {_after_row()} FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.done + 1)",
                 "conv_id, done")}),
ended AS (
  SELECT c.*, least(z, a) AS best FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.done)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(best.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""

NEGATIVES = """WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.uid AS anchor, a.id AS anchor_id, b.uid, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.uid <> b.uid WHERE a.id % 100 = 0),
pos AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, uid) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w::INTEGER AS rank, n.id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.id, n.uid) QUALIFY row_number() OVER w <= 5"""
