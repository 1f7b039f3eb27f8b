"""Registered queries: training samples over the order corpus."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.operators import pair_space, samples
from tabscout.plans.corpora import CORPUS_SQL, SQL_FULL, SQL_ROW, SQL_SCHEMA, order_corpus, stored_corpus
from tabscout.plans.registry import query, sql_h, table
from tabscout.session import scratch_path, spread, written
from tabscout.sources import pair_blocks

SEED = 42

# CTEs over "corpus": filled (with texts), dbs and tabs with their ordinals
INDEX_SQL = CORPUS_SQL + f""",
filled AS (SELECT *, {SQL_FULL} AS full_text, {SQL_SCHEMA} AS schema_text FROM corpus WHERE len(rows) > 0),
dbs AS (
  SELECT database_name, n_tables, row_number() OVER (ORDER BY {sql_h('database_name')}, database_name) - 1 AS db_ord,
         count(*) OVER () AS n_dbs
  FROM (SELECT database_name, count(*) AS n_tables FROM filled GROUP BY 1)),
tabs AS (
  SELECT f.database_name, table_name, full_text, schema_text, n_tables,
         row_number() OVER (PARTITION BY f.database_name
                            ORDER BY {sql_h('f.database_name', 'table_name')}, table_name) - 1 AS tab_ord
  FROM filled f JOIN dbs USING (database_name))
"""

# every unordered pair of tables of one database
POSITIVE_SQL = """
positives AS (
  SELECT a.database_name, a.table_name AS table_a, b.table_name AS table_b, 0.5::DOUBLE AS label
  FROM tabs a JOIN tabs b ON a.database_name = b.database_name AND a.tab_ord < b.tab_ord)
"""

_OTHER = "({x} + CASE WHEN {x} >= {own} THEN 1 ELSE 0 END)"


def _sql_other(n: str, own: str, *parts: str) -> str:
    return _OTHER.format(x=f"({sql_h(*parts)} % nullif({n} - 1, 0))", own=own)


NEGATIVE_SQL = f"""
drawn AS (
  SELECT database_name, {sql_h(f"'{SEED}'", 'database_name', '0', "'anchor'")} % n_tables AS tab_ord,
         {_sql_other('n_dbs', 'db_ord', f"'{SEED}'", 'database_name', '0', "'other'")} AS other_ord
  FROM dbs),
negatives AS (
  SELECT d.database_name, a.table_name AS table_a, o.database_name AS other_db, b.table_name AS table_b, 0.0::DOUBLE AS label
  FROM drawn d JOIN dbs o ON o.db_ord = d.other_ord
  JOIN tabs a ON a.database_name = d.database_name AND a.tab_ord = d.tab_ord
  JOIN tabs b ON b.database_name = o.database_name
   AND b.tab_ord = {sql_h(f"'{SEED}'", 'd.database_name', '0', "'negative'")} % o.n_tables)
"""

PAIRS_SQL = """
all_pairs AS (
  SELECT database_name AS db_a, table_a, database_name AS db_b, table_b, label FROM positives
  UNION ALL SELECT database_name, table_a, other_db, table_b, label FROM negatives)
"""


def triplet_sql(fk: bool, seed: int = SEED) -> str:
    """CTE "triples": as samples.triplets with one attempt target per non-empty table."""
    s = f"'{seed}'"
    referenced = (
        f"(SELECT l.targets[1 + {sql_h(s, 'attempt', repr('fk'))} % len(l.targets)] FROM fk_lists l "
        "WHERE l.database_name = db AND l.table_name = anchor)" if fk else "NULL"
    )
    fk_cte = """
edges AS (SELECT database_name, table_name, unnest(fks) AS target, generate_subscripts(fks, 1) AS pos FROM filled),
fk_lists AS (
  SELECT e.database_name, e.table_name, list(target ORDER BY pos) AS targets
  FROM edges e JOIN filled f ON f.database_name = e.database_name AND f.table_name = e.target GROUP BY 1, 2),
""" if fk else ""
    return f"""{fk_cte}
goal AS (SELECT count(*) AS target FROM filled),
attempts AS (
  SELECT attempt, db_ord, {_sql_other('n_dbs', 'db_ord', s, 'attempt', "'negative db'")} AS neg_db_ord
  FROM (SELECT attempt, (SELECT max(n_dbs) FROM dbs) AS n_dbs,
               {sql_h(s, 'attempt', "'db'")} % (SELECT max(n_dbs) FROM dbs) AS db_ord
        FROM (SELECT unnest(range(3 * (SELECT target FROM goal))) AS attempt))),
anchors AS (
  SELECT attempt, d.database_name AS db, d.n_tables AS n, nd.database_name AS negative_db, nd.n_tables AS neg_n,
         {sql_h(s, 'attempt', "'table'")} % d.n_tables AS tab_ord,
         {sql_h(s, 'attempt', "'negative'")} % nd.n_tables AS neg_ord
  FROM attempts x JOIN dbs d ON d.db_ord = x.db_ord JOIN dbs nd ON nd.db_ord = x.neg_db_ord),
named AS (
  SELECT attempt, db, t.table_name AS anchor, negative_db, g.table_name AS negative,
         {_sql_other('n', 'x.tab_ord', s, 'attempt', "'other'")} AS other_ord
  FROM anchors x JOIN tabs t ON t.database_name = db AND t.tab_ord = x.tab_ord
  JOIN tabs g ON g.database_name = negative_db AND g.tab_ord = neg_ord),
made AS (
  SELECT attempt, db, anchor, coalesce({referenced}, o.table_name) AS positive, negative_db, negative
  FROM named x LEFT JOIN tabs o ON o.database_name = db AND o.tab_ord = other_ord),
triples AS (SELECT * FROM made WHERE positive IS NOT NULL ORDER BY attempt LIMIT (SELECT target FROM goal)),
texted AS (
  SELECT r.*, a.full_text AS anchor_text, a.schema_text AS anchor_schema, p.full_text AS positive_text, q.full_text AS negative_text
  FROM triples r JOIN tabs a ON a.database_name = db AND a.table_name = anchor
  JOIN tabs p ON p.database_name = db AND p.table_name = positive
  JOIN tabs q ON q.database_name = negative_db AND q.table_name = negative)
"""


def triplet_goal(corpus) -> int:
    """One triplet per non-empty table."""
    return samples.nonempty(corpus).count()


@query("fk_targets", f"""WITH {CORPUS_SQL}, e AS (
  SELECT database_name, table_name, unnest(fks) AS reference_table, generate_subscripts(fks, 1) - 1 AS pos FROM corpus)
SELECT e.database_name, e.table_name, e.pos::INTEGER AS pos, e.reference_table
FROM e JOIN corpus c ON c.database_name = e.database_name AND c.table_name = e.reference_table""")
def fk_targets(spark, sf_dir):
    return samples.fk_targets(stored_corpus(spark, sf_dir)).select(
        "database_name", "table_name", "pos", "reference_table"
    )


@query("pc_pair_space", f"""WITH {INDEX_SQL}
SELECT database_name, table_name, tab_ord, tab_ord + 1 AS first_partner, n_tables - 1 AS last_partner,
       n_tables - 1 - tab_ord AS n_pairs, 0.5::DOUBLE AS label FROM tabs""")
def pc_pair_space(spark, sf_dir):
    return samples.pair_space(order_corpus(spark, sf_dir))


@query("pc_positive_pairs", f"""WITH {INDEX_SQL}, {POSITIVE_SQL}
SELECT p.database_name, table_a, table_b, label FROM positives p
JOIN tabs t ON t.database_name = p.database_name AND t.table_name = table_a AND t.tab_ord = 0""")
def pc_positive_pairs(spark, sf_dir):
    """All pairs of one anchor per database, the first table in hash order."""
    ix = samples.index(order_corpus(spark, sf_dir))
    return samples.pairs_of(ix, ix.tables.where("tab_ord = 0"))


@query("pc_positive_pair_texts", f"""WITH {INDEX_SQL}, {POSITIVE_SQL}, v AS (SELECT *, {SQL_ROW} AS row_text FROM filled)
SELECT p.database_name AS db_a, table_a, p.database_name AS db_b, table_b, label, a.row_text AS text_a, b.row_text AS text_b
FROM positives p JOIN v a ON a.database_name = p.database_name AND a.table_name = table_a
JOIN v b ON b.database_name = p.database_name AND b.table_name = table_b""")
def pc_positive_pair_texts(spark, sf_dir):
    """All pairs of all anchors, with row-view texts, from a file of blocks that holds each text once."""
    path = scratch_path(spark, "pair-blocks")
    pair_blocks.write_pair_blocks(stored_corpus(spark, sf_dir), path)
    return pair_blocks.read_pairs(spark, path)


@query("pc_negative_pairs", f"WITH {INDEX_SQL}, {NEGATIVE_SQL} SELECT * FROM negatives")
def pc_negative_pairs(spark, sf_dir):
    return samples.negative_pairs(samples.index(order_corpus(spark, sf_dir)), SEED)


@query("pc_pairs", f"""WITH {INDEX_SQL}, {NEGATIVE_SQL}
SELECT database_name AS db_a, table_name AS table_a, database_name AS db_b, NULL::VARCHAR AS table_b, tab_ord + 1 AS first_partner,
  n_tables - 1 AS last_partner, n_tables - 1 - tab_ord AS n_pairs, 0.5::DOUBLE AS label FROM tabs WHERE tab_ord < n_tables - 1
UNION ALL SELECT database_name, table_a, other_db, table_b, NULL, NULL, 1, label FROM negatives""")
def pc_pairs(spark, sf_dir):
    return samples.pairs(order_corpus(spark, sf_dir), SEED)


@query("pc_pair_texts", f"""WITH {INDEX_SQL}, {NEGATIVE_SQL}, v AS (SELECT *, {SQL_ROW} AS row_text FROM filled)
SELECT n.database_name AS db_a, table_a, other_db AS db_b, table_b, label, a.row_text AS text_a, b.row_text AS text_b
FROM negatives n JOIN v a ON a.database_name = n.database_name AND a.table_name = table_a
JOIN v b ON b.database_name = other_db AND b.table_name = table_b""")
def pc_pair_texts(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    listed = samples.negative_pairs(samples.index(corpus), SEED).withColumnsRenamed({"database_name": "db_a", "other_db": "db_b"})
    return samples.pair_texts(corpus, listed)


def _round_sql(side: str, other: str, modulus: str, turn: tuple[int, int, int]) -> str:
    prime = pair_space.PRIME
    y = f"(({other} % {prime} * {turn[0]} + {turn[1]}) % {prime})"
    return f"({side} + ({y} * {y} + {turn[2]}) % {prime}) % {modulus}"


def _permutation_sql() -> str:
    """CTE "permuted"(x, y): one step of pair_space.Permutation for all numbers below a x b."""
    inner = "SELECT x, a, b, x % a AS l, x // a AS r FROM (SELECT a, b, unnest(range(a * b)) AS x FROM geometry)"
    for j, turn in enumerate(pair_space.constants(SEED)):
        sides = (_round_sql("l", "r", "a", turn) + " AS l", "r") if j % 2 == 0 else ("l", _round_sql("r", "l", "b", turn) + " AS r")
        inner = f"SELECT x, a, b, {', '.join(sides)} FROM ({inner})"
    return f"permuted AS (SELECT x, r * a + l AS y FROM ({inner}))"


# CTE "placed": all pairs with their rank and their position in the seeded shuffle
SHUFFLE_SQL = f"""
space AS (
  SELECT *, coalesce(sum(n_tables * (n_tables - 1) // 2) OVER (ORDER BY db_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_rank
  FROM dbs),
sizes AS (
  SELECT sum(n_tables * (n_tables - 1) // 2)::BIGINT AS positives, (SELECT count(*) FROM negatives) AS n FROM dbs),
ranked AS (
  SELECT s.first_rank + a.tab_ord * (2 * a.n_tables - a.tab_ord - 1) // 2 + b.tab_ord - a.tab_ord - 1 AS rank,
    a.database_name AS db_a, a.table_name AS table_a, b.database_name AS db_b, b.table_name AS table_b, 0.5::DOUBLE AS label
  FROM tabs a JOIN tabs b ON a.database_name = b.database_name AND a.tab_ord < b.tab_ord JOIN space s ON s.database_name = a.database_name
  UNION ALL
  SELECT (SELECT positives FROM sizes) + db_ord, n.database_name, table_a, other_db, table_b, label FROM negatives n JOIN dbs USING (database_name)),
total AS (SELECT positives + n AS total, floor(sqrt(positives + n))::BIGINT AS root FROM sizes),
geometry AS (
  SELECT a, (total + a - 1) // a AS b, total FROM (
    SELECT total, root, unnest(range(root - least(root // 2, {pair_space.SEARCHED}), root + least(root // 2, {pair_space.SEARCHED}) + 1)) AS a FROM total)
  ORDER BY (a - total % a) % a, abs(a - root), a LIMIT 1),
{_permutation_sql()},
walk AS (
  SELECT x AS rank, y FROM permuted WHERE x < (SELECT total FROM total)
  UNION ALL SELECT w.rank, p.y FROM walk w JOIN permuted p ON p.x = w.y WHERE w.y >= (SELECT total FROM total)),
placed AS (SELECT r.*, y AS position FROM ranked r JOIN walk USING (rank) WHERE y < (SELECT total FROM total))
"""


def _space(spark, sf_dir):
    return pair_space.pair_space(samples.index(order_corpus(spark, sf_dir)), SEED)


@query("pc_pair_shuffle", f"WITH RECURSIVE {INDEX_SQL}, {NEGATIVE_SQL}, {SHUFFLE_SQL} SELECT position, db_a, table_a, db_b, table_b, label FROM placed")
def pc_pair_shuffle(spark, sf_dir):
    """All pairs, positive and negative, with their position in the seeded shuffle."""
    return pair_space.shuffled_pairs(_space(spark, sf_dir))


@query("pc_pair_batches", f"""WITH RECURSIVE {INDEX_SQL}, {NEGATIVE_SQL}, {SHUFFLE_SQL}
SELECT position // 16 AS batch, position, db_a, table_a, db_b, table_b, label FROM placed""")
def pc_pair_batches(spark, sf_dir):
    """One epoch of shuffled batches, found from their positions."""
    space = _space(spark, sf_dir)
    pairs = pair_space.pairs_at(space, 0, space.order.total)
    return pairs.select(F.call_function("div", F.col("position"), F.lit(16)).alias("batch"), *pairs.columns)


@query("pc_pair_split", f"""WITH RECURSIVE {INDEX_SQL}, {NEGATIVE_SQL}, {SHUFFLE_SQL},
cut AS (SELECT floor(0.9 * total) AS cut FROM total)
SELECT db_a AS database_name, table_a AS table_name, CASE WHEN label > 0 THEN 'positive' ELSE 'negative' END AS kind,
  count(*) AS n_pairs, count(*) FILTER (position < cut) AS n_train FROM placed, cut GROUP BY 1, 2, 3""")
def pc_pair_split(spark, sf_dir):
    """Exact sizes of the train and validation parts of every anchor's pairs."""
    return pair_space.split_counts(_space(spark, sf_dir))


_SPLIT_SQL = """SELECT {ids}, position, CASE WHEN position < {cut} THEN 'train' ELSE 'val' END AS split FROM shuffled"""


@query("train_val_split", f"""WITH {INDEX_SQL}, shuffled AS (
  SELECT database_name, table_name, row_number() OVER (ORDER BY {sql_h(f"'{SEED}'", 'database_name', 'table_name')}, database_name, table_name) - 1 AS position
  FROM filled)
{_SPLIT_SQL.format(ids='database_name, table_name', cut='floor(0.9 * (SELECT count(*) FROM shuffled))')}""")
def train_val_split(spark, sf_dir):
    """Self-pairs, by the table both sides show."""
    ids = written(samples.self_pairs(order_corpus(spark, sf_dir)).select("database_name", "table_name"), "self-pairs")
    return samples.split(samples.shuffled(ids, ["database_name", "table_name"], SEED))


@query("train_val_split_triplets", f"""WITH {INDEX_SQL}, {triplet_sql(True)}, shuffled AS (
  SELECT attempt, db, anchor, positive, negative_db, negative,
    row_number() OVER (ORDER BY {sql_h(f"'{SEED}'", 'attempt')}, attempt) - 1 AS position FROM triples)
{_SPLIT_SQL.format(ids='attempt, db, anchor, positive, negative_db, negative',
                   cut='(SELECT count(*) - greatest(1, floor(0.1 * count(*))) FROM shuffled)')}""")
def train_val_split_triplets(spark, sf_dir):
    """Triplets; at least one goes to the validation part."""
    corpus = stored_corpus(spark, sf_dir)
    drawn = written(samples.triplets(corpus, triplet_goal(corpus), SEED), "triplets")
    return samples.split(samples.shuffled(drawn, ["attempt"], SEED), at_least_one=True)


@query("ssc_pairs", f"WITH {INDEX_SQL} SELECT database_name, table_name, full_text AS text_a, full_text AS text_b FROM filled")
def ssc_pairs(spark, sf_dir):
    return samples.self_pairs(order_corpus(spark, sf_dir))


@query("mlm_texts", f"WITH {INDEX_SQL} SELECT database_name, table_name, full_text AS text FROM filled")
def mlm_texts(spark, sf_dir):
    return samples.plain_texts(order_corpus(spark, sf_dir))


_TRIPLET_COLUMNS = "attempt, db, anchor, positive, negative_db, negative, anchor_text, positive_text, negative_text"


@query("tc_triplets", f"WITH {INDEX_SQL}, {triplet_sql(True)} SELECT {_TRIPLET_COLUMNS} FROM texted")
def tc_triplets(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    return samples.triplet_texts(corpus, samples.triplets(corpus, triplet_goal(corpus), SEED))


@query("tc_triplets_samedb", f"WITH {INDEX_SQL}, {triplet_sql(False)} SELECT {_TRIPLET_COLUMNS} FROM texted")
def tc_triplets_samedb(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    return samples.triplet_texts(corpus, samples.triplets(corpus, triplet_goal(corpus), SEED, fk_positives=False))


@query("tc_opt_triplets", f"""WITH {INDEX_SQL}, {triplet_sql(False)}, v AS (
  SELECT *, {sql_h(f"'{SEED}'", 'attempt', "'view'")} % 2 AS drawn FROM texted)
SELECT attempt, db, anchor, positive, negative_db, negative, CASE drawn WHEN 0 THEN 'full' ELSE 'schema' END AS view,
  CASE drawn WHEN 0 THEN anchor_text ELSE anchor_schema END AS anchor_text, positive_text, negative_text FROM v""")
def tc_opt_triplets(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    ids = samples.triplets(corpus, triplet_goal(corpus), SEED, fk_positives=False, views=["full", "schema"])
    return samples.triplet_texts(corpus, ids)


@query("tc_sb_batches", f"""WITH {INDEX_SQL}, {triplet_sql(False)}, s AS (
  SELECT *, row_number() OVER (ORDER BY left(anchor_text, 60), attempt) - 1 AS position FROM texted)
SELECT {_TRIPLET_COLUMNS}, position, position // 16 AS batch FROM s""")
def tc_sb_batches(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    ids = samples.triplets(corpus, triplet_goal(corpus), SEED, fk_positives=False)
    return samples.smart_batches(samples.triplet_texts(corpus, ids))


def mask_sql(texts: str, ids: str, text: str = "text") -> str:
    """CTE chain ending in "windows" for samples.mask_tokens."""
    key = [f"'{SEED}'", *ids.split(", ")]
    return f"""
toks AS (SELECT {ids}, list_filter(string_split_regex({text}, '\\s+'), lambda t: t <> '') AS toks FROM {texts}),
one AS (SELECT {ids}, toks, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS i FROM toks),
drawn AS (SELECT *, {sql_h(*key, 'i')} AS r FROM one),
hashed AS (SELECT *, r % 100 < 15 AS chosen, (r // 100) % 10 AS kind, toks[1 + (r // 1000) % len(toks)] AS swap FROM drawn),
windows AS (
  SELECT {ids}, (i // 512)::INTEGER AS "window",
         list(CASE WHEN chosen AND kind < 8 THEN '[MASK]' WHEN chosen AND kind = 8 THEN swap ELSE tok END ORDER BY i) AS tokens,
         list(CASE WHEN chosen THEN tok END ORDER BY i) AS labels
  FROM hashed GROUP BY {ids}, i // 512)
"""


@query("mlm_masking", f"WITH {INDEX_SQL}, {mask_sql('filled', 'database_name, table_name', 'full_text')} SELECT * FROM windows")
def mlm_masking(spark, sf_dir):
    return samples.mask_tokens(samples.plain_texts(order_corpus(spark, sf_dir)))


@query("mlm_masking_documents", f"WITH {mask_sql('documents', 'doc_id')} SELECT * FROM windows")
def mlm_masking_documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return samples.mask_tokens(docs, ids=("doc_id",))


@query("first_n_databases", f"""WITH {CORPUS_SQL}
SELECT database_name, table_name FROM corpus
WHERE database_name IN (SELECT DISTINCT database_name FROM corpus ORDER BY 1 LIMIT 50)""")
def first_n_databases(spark, sf_dir):
    return samples.first_databases(order_corpus(spark, sf_dir), 50).select("database_name", "table_name")


_LINE_IDS = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice_cents", "l_ship_day"]


@query("sample_rows_per_table", f"""WITH l AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_extendedprice::DECIMAL(18,2) * 100)::BIGINT AS l_extendedprice_cents,
         strftime(l_shipdate, '%Y-%m-%d') AS l_ship_day FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY
  {sql_h(f"'{SEED}'", 'l_orderkey', *_LINE_IDS)}, {', '.join(_LINE_IDS)})::INTEGER AS draw FROM l)
SELECT * FROM d WHERE draw <= 3""")
def sample_rows_per_table(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("bigint").alias("l_extendedprice_cents"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_ship_day"),
    )
    return samples.sample_per_group(lines, ["l_orderkey"], _LINE_IDS, 3, SEED)


@query("sample_tables", f"""WITH {CORPUS_SQL}, n AS (SELECT count(*) // 10 AS n FROM corpus)
SELECT database_name, table_name FROM corpus ORDER BY {sql_h(f"'{SEED}'", 'database_name', 'table_name')}, 1, 2 LIMIT (SELECT n FROM n)""")
def sample_tables(spark, sf_dir):
    """A tenth of the tables, drawn without replacement."""
    ids = written(order_corpus(spark, sf_dir).select("database_name", "table_name"), "ids")
    return samples.sample(ids, ["database_name", "table_name"], ids.count() // 10, SEED)
