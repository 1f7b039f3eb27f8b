"""Registered queries: encoding, search, similar tables and ranking quality."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from tabscout.functions.vectors import normalise
from tabscout.operators import encode, pivot_tree, prefixes, projections, ranking, samples, search
from tabscout.plans.corpora import CORPUS_SQL, DOCUMENTS_SQL, document_corpus, order_corpus
from tabscout.plans.registry import query, sql_h, table
from tabscout.session import scratch_path, spread, written
from tabscout.sources import run_files

DIM = 64
MODELS = {"full": 64, "half": 32, "quarter": 16}  # leading dimensions that make up a model's vector
DEPTH = 60


def sql_encode(source: str, ids: str, text: str, out: str, dim: int = DIM) -> str:
    """CTE chain: hashed unit vectors of ``source`` rows as ``out``(ids, embedding)."""
    p = out
    return f"""
{p}_tok AS (SELECT {ids}, unnest(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS t FROM {source}),
{p}_code AS (SELECT {ids}, {sql_h('t')} % {2 * dim} AS c FROM {p}_tok),
{p}_sum AS (SELECT {ids}, c % {dim} AS d, sum(CASE WHEN c >= {dim} THEN -1.0 ELSE 1.0 END)::DOUBLE AS s FROM {p}_code GROUP BY ALL),
{p}_map AS (SELECT {ids}, map(list(d), list(s)) AS m, sqrt(sum(s * s)) AS n FROM {p}_sum GROUP BY ALL),
{out} AS (
  SELECT {ids}, list_transform(range({dim}), lambda i:
           coalesce(m[i], 0.0) / CASE WHEN n > 0 THEN n ELSE 1.0 END) AS embedding
  FROM (SELECT {ids} FROM {source}) LEFT JOIN {p}_map USING ({ids}))
"""


_ROUNDED = "list_transform(embedding, lambda x: round(x, 6) + 0.0) AS embedding"


def _rounded(vector="embedding"):
    return F.transform(vector, lambda x: F.round(x, 6) + F.lit(0.0)).alias("embedding")


# --- encoding ---------------------------------------------------------------------------------

@query("hash_encode", f"WITH {sql_encode('documents', 'doc_id', 'text', 'vec')} SELECT doc_id, {_ROUNDED} FROM vec")
def hash_encode(spark, sf_dir):
    docs = encode.encode_hashed(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))
    return docs.select("doc_id", _rounded())


@query("normalise_vectors", f"""WITH s AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + label)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM s)
SELECT vec_id, list_transform(v, lambda x: round(x / n, 6) + 0.0) AS embedding FROM n""")
def normalise_vectors(spark, sf_dir):
    scaled = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label"))).alias("embedding")
    )
    return encode.unit(scaled).select("vec_id", _rounded())


_CELL_SQL = f"""cells AS (
  SELECT l_orderkey, row_number() OVER () AS cell_id, cell FROM (
    SELECT l_orderkey, unnest([l_returnflag || ' ' || l_linestatus, l_partkey::VARCHAR, l_suppkey::VARCHAR,
                               l_quantity::DECIMAL(18,2)::VARCHAR]) AS cell FROM lineitem)),
{sql_encode('cells', 'cell_id', 'cell', 'cv')},
dims AS (SELECT l_orderkey, unnest(embedding) AS x, unnest(range({DIM})) AS d FROM cv JOIN cells USING (cell_id)),
means AS (SELECT l_orderkey, d, round(avg(x), 6) + 0.0 AS x FROM dims GROUP BY 1, 2)
SELECT l_orderkey, list(x ORDER BY d) AS embedding FROM means GROUP BY 1"""


@query("mean_pool", "WITH " + _CELL_SQL)
def mean_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array(
        F.concat_ws(" ", "l_returnflag", "l_linestatus"), F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("decimal(18,2)").cast("string"),
    ).alias("cells"))
    return encode.mean_pool(spread(rows, "l_orderkey"), ["l_orderkey"]).select("l_orderkey", _rounded())


@query("embedding_size_stats", f"""WITH m(model, dim) AS (VALUES {', '.join(f"('{m}', {d})" for m, d in MODELS.items())})
SELECT 'ds_' || label AS dataset, model, count(*) AS embeddings_count, max(least(dim, len(embedding)))::INTEGER AS embedding_dimension,
  sum(4 * least(dim, len(embedding)))::BIGINT AS embeddings_size_bytes,
  round(sum(4 * least(dim, len(embedding))) / (1024 * 1024), 4) AS embeddings_size_mb
FROM embeddings, m GROUP BY 1, 2""")
def embedding_size_stats(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("ds_"), F.col("label").cast("string")).alias("dataset"),
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("model"), F.slice("embedding", 1, d).alias("embedding")) for m, d in MODELS.items()
        ])),
    )
    return encode.size_stats(vectors)


# --- search -----------------------------------------------------------------------------------

def model_vectors(spark, sf_dir: str, model: str = "full"):
    """(table_id, embedding): unit vectors of one model."""
    part = F.slice("embedding", 1, MODELS[model])
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("table_id"), normalise(part).alias("embedding")
    )


def as_queries(vectors):
    return vectors.select(F.col("table_id").alias("query_id"), "embedding")


def classes(spark, sf_dir: str):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"))


def model_rankings(spark, sf_dir: str, k: int, models=tuple(MODELS), exclude_self: bool = True):
    """Every vector as a query over all others, per model."""
    out = None
    for model in models:
        vectors = model_vectors(spark, sf_dir, model)
        r = search.exact_topk(as_queries(vectors), vectors, k, exclude_self).withColumn("model", F.lit(model))
        out = r if out is None else out.unionByName(r)
    return out


def sql_rankings(k: int, models=tuple(MODELS), exclude_self: bool = True) -> str:
    """CTE "rankings"(model, query_id, rank, table_id, score) and "labels_of"."""
    values = ", ".join(f"('{m}', {MODELS[m]})" for m in models)
    keep = "WHERE a.vec_id <> b.vec_id" if exclude_self else ""
    return f"""
models(model, dim) AS (VALUES {values}),
cutv AS (SELECT model, vec_id, list_transform(embedding[1:dim], lambda x: x::DOUBLE) AS v FROM embeddings, models),
unitv AS (SELECT model, vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS e FROM cutv),
scored AS (
  SELECT a.model, a.vec_id AS query_id, b.vec_id AS table_id, round(list_dot_product(a.e, b.e), 6) + 0.0 AS score
  FROM unitv a JOIN unitv b ON a.model = b.model {keep}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, table_id)::INTEGER AS rank FROM scored),
rankings AS (SELECT * FROM ranked WHERE rank <= {k})
"""


_TOPK = f"WITH {sql_rankings(10, ('full',))} SELECT query_id, rank, table_id, score FROM rankings"


@query("topk_cosine", _TOPK)
def topk_cosine(spark, sf_dir):
    return model_rankings(spark, sf_dir, 10, ("full",)).drop("model")


@query("topk_cosine_cells", _TOPK)
def topk_cosine_cells(spark, sf_dir):
    """The way taken for query sets too large to broadcast."""
    vectors = model_vectors(spark, sf_dir)
    return search.cell_topk(as_queries(vectors), vectors, 10, exclude_self=True, n_pivots=16)


@query("topk_cosine_tree", _TOPK)
def topk_cosine_tree(spark, sf_dir):
    """The way taken for corpora beyond a flat set of cells."""
    vectors = model_vectors(spark, sf_dir)
    return pivot_tree.tree_topk(as_queries(vectors), vectors, 10, exclude_self=True, n_cells=64)


@query("topk_text", f"""WITH src AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations),
{sql_encode('src', 'query_id', 'text', 'qv')}, {sql_encode('documents', 'doc_id', 'text', 'dv')},
scored AS (SELECT query_id, doc_id AS table_id, round(list_dot_product(a.embedding, b.embedding), 6) + 0.0 AS score FROM qv a, dv b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, table_id, score FROM ranked WHERE rank <= 10""")
def topk_text(spark, sf_dir):
    """Texts as queries over encoded documents."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    queries = encode.encode_hashed(spread(turns, "conv_id", "turn")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "embedding"
    )
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    docs = encode.encode_hashed(texts).select(F.col("doc_id").alias("table_id"), "embedding")
    return search.exact_topk(written(queries, "queries"), written(docs, "vectors"), 10)


_PIVOTS, _PROBES = 16, 4
_ANN_SQL = f"""WITH {sql_rankings(10, ('full',))},
pivots AS (SELECT e, row_number() OVER (ORDER BY {sql_h('vec_id')}, vec_id) AS cell FROM unitv
           QUALIFY cell <= {_PIVOTS}),
near AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(u.e, p.e), 6) DESC, cell) AS place
         FROM unitv u, pivots p),
reach AS (SELECT q.vec_id AS query_id, m.vec_id AS table_id FROM near q JOIN near m ON q.cell = m.cell
          WHERE q.place <= {_PROBES} AND m.place = 1),
found AS (SELECT query_id, table_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id)::INTEGER AS rank
          FROM scored JOIN reach USING (query_id, table_id) QUALIFY rank <= 10)
"""


@query("topk_ann_cells", _ANN_SQL + "SELECT query_id, rank, table_id, score FROM found")
def topk_ann_cells(spark, sf_dir):
    """By probing a fixed number of cells."""
    vectors = model_vectors(spark, sf_dir)
    return search.approx_topk(as_queries(vectors), vectors, 10, _PROBES, _PIVOTS, exclude_self=True)


_TABLES = projections.TABLES
_PROJECTED_SQL = f"""WITH {sql_rankings(10, ('full',))},
sized AS (SELECT CASE WHEN count(*) > {projections.ROWS_PER_CODE} THEN
  least({projections.MOST_BITS}, greatest(3, floor(log2(count(*) / {projections.ROWS_PER_CODE})))) ELSE 3 END::BIGINT AS bits FROM unitv),
plane_ids AS (
  SELECT t, p, d, bits FROM sized, (SELECT unnest(range({_TABLES})) AS t), (SELECT unnest(range({projections.MOST_BITS})) AS p), (SELECT unnest(range({DIM})) AS d)
  WHERE p < bits),
planes AS (SELECT t, p, list(2.0 * ({sql_h("'42'", 't', 'p', 'd')} % 2) - 1 ORDER BY d) AS s FROM plane_ids GROUP BY 1, 2),
margins AS (
  SELECT vec_id, t, list(round(list_dot_product(e, s), 6) + 0.0 ORDER BY p) AS m FROM unitv, planes GROUP BY 1, 2),
codes AS (
  SELECT vec_id, t, m, list_sum(list_transform(range(len(m)), lambda i: CASE WHEN m[i + 1] >= 0 THEN 1 << i ELSE 0 END))::BIGINT AS code FROM margins),
costs AS (
  SELECT vec_id, t, c, round(list_sum(list_transform(range(len(m)), lambda i: CASE WHEN (c >> i) & 1 <> (code >> i) & 1 THEN m[i + 1] * m[i + 1] ELSE 0 END)), 9) AS cost
  FROM codes, sized, (SELECT unnest(range(1 << {projections.PROBED_BITS})) AS c) WHERE c < (1 << bits)),
places AS (SELECT vec_id, t, c, row_number() OVER (PARTITION BY vec_id, t ORDER BY cost, c) AS place FROM costs),
near AS (
  SELECT p.vec_id AS query_id, x.vec_id AS table_id, min(place) AS place FROM places p JOIN codes x ON x.t = p.t AND x.code = p.c GROUP BY 1, 2),
learned AS (SELECT vec_id AS query_id FROM unitv ORDER BY {sql_h('vec_id')}, vec_id LIMIT {projections.SAMPLE}),
needed AS (SELECT list_sort(list(place)) AS all_places FROM rankings r JOIN learned USING (query_id) JOIN near USING (query_id, table_id)),
probes AS (SELECT all_places[ceil(round({projections.RECALL} * len(all_places), 6))::BIGINT] AS n FROM needed),
found AS (
  SELECT query_id, table_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id)::INTEGER AS rank
  FROM scored JOIN near USING (query_id, table_id), probes WHERE place <= n QUALIFY rank <= 10)
"""


def _approx(spark, sf_dir):
    vectors = model_vectors(spark, sf_dir)
    return projections.projection_topk(as_queries(vectors), vectors, 10, exclude_self=True)


@query("topk_ann", _PROJECTED_SQL + "SELECT query_id, rank, table_id, score FROM found")
def topk_ann(spark, sf_dir):
    """Through random-projection tables, with as many probes as a recall of 0.95 takes."""
    return _approx(spark, sf_dir)


@query("topk_ann_recall", _PROJECTED_SQL + """
SELECT query_id, count(f.table_id) AS found, count(*) AS wanted, round(count(f.table_id) / count(*), 6) AS recall
FROM rankings r LEFT JOIN found f USING (query_id, table_id) GROUP BY 1""")
def topk_ann_recall(spark, sf_dir):
    return search.recall_against(_approx(spark, sf_dir), topk_cosine(spark, sf_dir), 10)


@query("model_comparison_topk", f"""WITH {sql_rankings(5)}
SELECT model, query_id, arg_min(table_id, rank) AS top_table, max(score) AS top_score, round(avg(score), 6) AS avg_top5
FROM rankings GROUP BY 1, 2""")
def model_comparison_topk(spark, sf_dir):
    return model_rankings(spark, sf_dir, 5).groupBy("model", "query_id").agg(
        F.min_by("table_id", "rank").alias("top_table"), F.max("score").alias("top_score"),
        F.round(F.avg("score"), 6).alias("avg_top5"),
    )


@query("self_retrieval", f"""WITH {sql_rankings(10, tuple(MODELS), False)},
q AS (SELECT model, query_id, min(CASE WHEN query_id = table_id THEN rank END) AS own FROM rankings GROUP BY 1, 2)
SELECT model, count(*) AS queries, round(avg(coalesce(1.0 / own, 0)), 6) AS mrr,
  round(avg((coalesce(own, 99) <= 5)::INT), 6) AS recall_5, round(avg((coalesce(own, 99) <= 10)::INT), 6) AS recall_10
FROM q GROUP BY 1""")
def self_retrieval(spark, sf_dir):
    found = model_rankings(spark, sf_dir, 10, exclude_self=False)
    own = F.min(F.when(F.col("query_id") == F.col("table_id"), F.col("rank"))).alias("own")
    per_query = found.groupBy("model", "query_id").agg(own)
    hit = lambda k: F.round(F.avg((F.coalesce("own", F.lit(99)) <= k).cast("int")), 6).alias(f"recall_{k}")
    return per_query.groupBy("model").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("own"), F.lit(0.0))), 6).alias("mrr"),
        hit(5), hit(10),
    )


# --- similar tables ---------------------------------------------------------------------------

_MIN_ROWS, _SIMILAR = 3, 5

_SIMILAR_SQL = f"""WITH {DOCUMENTS_SQL}, {sql_encode('docs', 'table_id', 'text', 'vec')},
valid AS (SELECT table_id FROM docs WHERE len("table") - 1 >= {_MIN_ROWS}),
scored AS (SELECT a.table_id AS query_id, b.table_id, round(list_dot_product(a.embedding, b.embedding), 6) + 0.0 AS score FROM vec a, vec b),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) AS r FROM scored QUALIFY r <= {_SIMILAR + 1}),
similars AS (SELECT query_id, table_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id)::INTEGER AS rank
  FROM hits WHERE table_id <> query_id AND table_id IN (FROM valid) QUALIFY rank <= {_SIMILAR})
"""


def _valid(spark, sf_dir):
    rows = document_corpus(spark, sf_dir).select(
        "table_id", F.explode(F.slice("table", 2, F.size("table"))).alias("row")
    )
    return search.valid_tables(rows, "table_id", _MIN_ROWS)


def _similar(spark, sf_dir):
    texts = spread(document_corpus(spark, sf_dir).select("table_id", "text"), "table_id")
    vectors = written(encode.encode_hashed(texts).select("table_id", "embedding"), "vectors")
    return search.similar_tables(vectors, _valid(spark, sf_dir), _SIMILAR)


@query("valid_tables", f"""WITH {DOCUMENTS_SQL}
SELECT table_id, (len("table") - 1)::BIGINT AS n_rows FROM docs WHERE len("table") - 1 >= {_MIN_ROWS}""")
def valid_tables(spark, sf_dir):
    return _valid(spark, sf_dir)


@query("similar_tables", _SIMILAR_SQL + "SELECT query_id, rank, table_id, score FROM similars")
def similar_tables(spark, sf_dir):
    return _similar(spark, sf_dir)


_EVIDENCE_SQL = _SIMILAR_SQL + """, facts AS (
  SELECT table_id, "table"[1] AS cols, CASE WHEN len("table") > 1 THEN
    list_transform(range(1, len("table"[1]) + 1), lambda i: coalesce("table"[2][i], '')) END AS first_row FROM docs),
p AS (
  SELECT s.*, a.cols AS acols, a.first_row AS arow, b.cols AS bcols, b.first_row AS brow,
    CASE WHEN a.first_row IS NULL OR b.first_row IS NULL THEN [] ELSE
      list_sort(list_distinct(list_filter(a.cols, lambda c: list_contains(b.cols, c)))) END AS shared
  FROM similars s JOIN facts a ON a.table_id = query_id JOIN facts b ON b.table_id = s.table_id),
e AS (
  SELECT *, list_filter(shared, lambda c: regexp_matches(lower(c), 'id|key|code|ref')) AS fks,
    list_filter(shared, lambda c: arow[list_position(acols, c)] <> '' AND
      arow[list_position(acols, c)] = brow[list_position(bcols, c)])[1] AS hit FROM p),
t AS (
  SELECT *, concat_ws(' | ', CASE WHEN len(shared) > 0 THEN 'shared_columns:' || array_to_string(shared, ',') END,
    CASE WHEN len(fks) > 0 THEN 'potential_fk:' || array_to_string(fks, ',') END,
    CASE WHEN hit IS NOT NULL THEN 'value_match:' || hit || '=' || arow[list_position(acols, hit)] END) AS ev FROM e)
SELECT query_id AS query_table, coalesce(array_to_string(arow, ' '), '') AS query_sample, rank, table_id AS candidate_table,
  score AS similarity_score, CASE WHEN ev = '' THEN 'embedding_similarity_only' ELSE ev END AS evidence,
  coalesce(array_to_string(brow, ' '), '') AS candidate_sample FROM t"""


@query("pair_evidence", _EVIDENCE_SQL)
def pair_evidence(spark, sf_dir):
    """Similar tables with the reason and a sample row of both."""
    header = F.get("table", 0)
    row = F.get("table", 1)
    facts = document_corpus(spark, sf_dir).select(
        "table_id", header.alias("columns"),
        F.when(F.size("table") > 1, F.transform(header, lambda c, i: F.coalesce(F.get(row, i), F.lit("")))).alias("first_row"),
    )
    shown = lambda key, out: facts.select(
        F.col("table_id").alias(key), F.coalesce(F.array_join("first_row", " "), F.lit("")).alias(out)
    ).hint("merge")
    found = search.pair_evidence(_similar(spark, sf_dir), facts)
    return (
        found.join(shown("query_id", "query_sample"), "query_id").join(shown("table_id", "candidate_sample"), "table_id")
        .select(
            F.col("query_id").alias("query_table"), "query_sample", "rank", F.col("table_id").alias("candidate_table"),
            F.col("score").alias("similarity_score"), "evidence", "candidate_sample",
        )
    )


@query("evidence_file", _EVIDENCE_SQL)
def evidence_file(spark, sf_dir):
    """The same as a CSV file, read back."""
    path = scratch_path(spark, "evidence")
    run_files.write_evidence(pair_evidence(spark, sf_dir), path)
    return run_files.read_evidence(spark, path).drop("processing_time")


@query("prefix_join", f"""WITH {CORPUS_SQL}, d AS (SELECT DISTINCT database_name AS db FROM corpus)
SELECT db, name FROM (SELECT database_name || '__' || table_name AS name FROM corpus) JOIN d ON starts_with(name, db)""")
def prefix_join(spark, sf_dir):
    corpus = order_corpus(spark, sf_dir)
    names = corpus.select(F.concat_ws("__", "database_name", "table_name").alias("name"))
    return prefixes.prefix_join(names, corpus.select(F.col("database_name").alias("db"))).select("db", "name")


@query("longest_prefix_join", """WITH d AS (SELECT DISTINCT p_brand AS db FROM part UNION SELECT DISTINCT p_brand || '-' || p_type FROM part),
n AS (SELECT p_partkey, p_brand || '_' || p_type || '_' || p_name || '_v' || p_size AS name FROM part)
SELECT p_partkey, name, (SELECT db FROM d WHERE starts_with(replace(name, '-', '_'), replace(db, '-', '_') || '_')
  ORDER BY length(db) DESC, db DESC LIMIT 1) AS db FROM n""")
def longest_prefix_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    dbs = part.select(F.explode(F.array("p_brand", F.concat_ws("-", "p_brand", "p_type"))).alias("db"))
    names = part.select(
        "p_partkey",
        F.concat_ws("_", "p_brand", "p_type", "p_name", F.concat(F.lit("v"), F.col("p_size").cast("string"))).alias("name"),
    )
    return prefixes.longest_prefix(names, dbs).select("p_partkey", "name", "db")


# --- ranking quality --------------------------------------------------------------------------

_JUDGED_SQL = f"""{sql_rankings(DEPTH)},
lab AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) - 1 AS n_relevant FROM embeddings),
judged AS (
  SELECT model, query_id, rank, table_id, q.n_relevant, q.label = t.label AS hit,
    sum((q.label = t.label)::INT) OVER (PARTITION BY model, query_id ORDER BY rank) AS hits_so_far
  FROM rankings JOIN lab q ON q.vec_id = query_id JOIN lab t ON t.vec_id = table_id),
per_query AS (
  SELECT model, query_id, any_value(n_relevant) AS n_rel,
    sum(CASE WHEN hit THEN hits_so_far / rank ELSE 0 END) / any_value(n_relevant) AS ap,
    coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0) AS rr,
    coalesce(1.0 / min(CASE WHEN hit AND rank <= 10 THEN rank END), 0) AS rr_10,
    {', '.join(f'''sum(CASE WHEN hit AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, 1 + least({k}, any_value(n_relevant))), lambda i: 1 / log2(i + 1))) AS ndcg_{k}'''
               for k in (5, 10, 20, 60))},
    {', '.join(f'count(CASE WHEN hit AND rank <= {k} THEN 1 END) AS hits_{k}' for k in (1, 5, 10))}
  FROM judged GROUP BY 1, 2),
metrics AS (
  SELECT *, {', '.join(f'hits_{k} / {k} AS precision_{k}, hits_{k} / n_rel AS recall_{k}, coalesce(2 * (hits_{k} / {k}) * (hits_{k} / n_rel) / nullif(hits_{k} / {k} + hits_{k} / n_rel, 0), 0) AS f1_{k}, (hits_{k} >= n_rel)::INT AS containment_{k}' for k in (1, 5, 10))}
  FROM per_query)
"""

# averages over the whole ranking carry the depth to which the rankings go
_OUT = {"ap": f"map_{DEPTH}", "rr": f"mrr_{DEPTH}", "rr_10": "mrr_10"}
_DEPTH_NAMES = {"map": f"map_{DEPTH}", "mrr": f"mrr_{DEPTH}"}


def _metric_sql(metrics, extra: str = "") -> str:
    cols = ", ".join(f"round(avg({m}), 6) AS {_OUT.get(m, m)}" for m in metrics)
    return f"WITH {_JUDGED_SQL} SELECT model, {cols}{extra} FROM metrics GROUP BY model"


def _judged(spark, sf_dir, depth: int = DEPTH):
    """Judged rankings and the queries, per model; relevant tables share the query's label."""
    members = classes(spark, sf_dir)
    judged = ranking.judge_by_class(model_rankings(spark, sf_dir, depth), members)
    models = F.explode(F.array(*map(F.lit, MODELS)))
    return judged, ranking.class_counts(members).withColumn("model", models)


def _register_metric(name: str, metrics: list[str], depth: int = DEPTH) -> None:
    @query(name, _metric_sql(metrics))
    def run(spark, sf_dir):
        judged, queries = _judged(spark, sf_dir, depth)
        return ranking.evaluate(judged, queries, metrics, keys=["model"]).withColumnsRenamed(_DEPTH_NAMES)


_register_metric("metric_map_60", ["ap"])
_register_metric("metric_mrr_60", ["rr"])
_register_metric("metric_mrr_at_10", ["rr_10"], 10)
_register_metric("metric_ndcg", ["ndcg_5", "ndcg_10", "ndcg_20", "ndcg_60"])
_register_metric("metric_prf_at_5", ["precision_5", "recall_5", "f1_5"], 5)
_register_metric("metric_recall", ["recall_1", "recall_5", "recall_10"], 10)
_register_metric("metric_containment", ["containment_1", "containment_5", "containment_10"], 10)
_register_metric("report_adhoc", ["ap", "rr", "ndcg_5", "ndcg_10", "ndcg_20", "ndcg_60"])
_register_metric("report_evidence", ["precision_5", "recall_5", "f1_5"], 5)
_register_metric("report_recall", ["recall_1", "recall_5", "recall_10"], 10)
_register_metric("report_grounding", ["containment_1", "containment_5", "containment_10", "rr_10", "ndcg_10"], 10)

# report names of the three models: one per architecture class
_REPORT_NAMES = {"full": "qwen-full", "half": "bge-half", "quarter": "bert-quarter"}


@query("report_architecture", f"""WITH {_JUDGED_SQL}, r AS (
  SELECT CASE model {' '.join(f"WHEN '{m}' THEN '{n}'" for m, n in _REPORT_NAMES.items())} END AS model,
    round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(rr), 6) AS mrr_{DEPTH}, round(avg(ndcg_10), 6) AS ndcg_10
  FROM metrics GROUP BY 1)
SELECT *, CASE WHEN model LIKE '%bge%' THEN 'Hybrid' WHEN model LIKE '%qwen%' THEN 'Decoder-Only' ELSE 'Bidirectional' END AS architecture,
  CASE WHEN model LIKE '%bge%' THEN '335M' WHEN model LIKE '%qwen%' THEN '7B' ELSE '110M' END AS parameters,
  CASE WHEN model LIKE '%bge%' THEN 2 WHEN model LIKE '%qwen%' THEN 1 ELSE 3 END AS place FROM r""")
def report_architecture(spark, sf_dir):
    judged, queries = _judged(spark, sf_dir)
    report = ranking.evaluate(judged, queries, ["recall_5", "recall_10", "rr", "ndcg_10"], keys=["model"]).withColumnsRenamed(_DEPTH_NAMES)
    named = report.withColumn(
        "model", F.coalesce(*[F.when(F.col("model") == m, n) for m, n in _REPORT_NAMES.items()])
    )
    return ranking.with_architecture(named).orderBy("place", "model")


# relevance lists: the tables an order's table refers to
_FK_QRELS_SQL = f"""{CORPUS_SQL}, qrels AS (
  SELECT DISTINCT c.table_name AS query_id, t.table_name AS table_id
  FROM (SELECT database_name, table_name, unnest(fks) AS target FROM corpus) c
  JOIN corpus t ON t.database_name = c.database_name AND t.table_name = c.target)
"""


def fk_qrels(corpus):
    return samples.fk_targets(corpus).select(
        F.col("table_name").alias("query_id"), F.col("reference_table").alias("table_id")
    ).distinct()


# queries are databases: their ten dearest orders, judged by the tables that others refer to
_VALUE_SQL = f"""{_FK_QRELS_SQL},
db_qrels AS (SELECT DISTINCT database_name AS query_id, table_id FROM qrels JOIN corpus ON table_name = qrels.table_id),
ranked AS (
  SELECT 'cust_' || o_custkey AS query_id, 'order_' || o_orderkey AS table_id,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank
  FROM orders QUALIFY rank <= 10),
gold AS (SELECT query_id, count(*) AS n, string_agg(table_id, '|' ORDER BY table_id) AS relevant FROM db_qrels GROUP BY 1)
"""


def _value_rankings(spark, sf_dir, depth: int | None = 10):
    """Queries are databases, their relevant tables those that others refer to; ranked by order value."""
    corpus = order_corpus(spark, sf_dir)
    qrels = (
        fk_qrels(corpus).select("table_id").distinct()
        .join(corpus.select(F.col("table_name").alias("table_id"), F.col("database_name").alias("query_id")), "table_id")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("query_id"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("table_id"),
        F.col("o_totalprice").alias("score"), "o_orderkey",
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "o_orderkey")
    ranks = orders.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "table_id")
    if depth is not None:
        ranks = ranks.filter(F.col("rank") <= depth)
    queries = orders.select("query_id").distinct()
    return ranks, queries, qrels


@query("rankings_report", f"""WITH {_VALUE_SQL}
SELECT 'orders' AS dataset, query_id AS query_index, 'orders of ' || query_id AS query, rank, table_id AS retrieved_table FROM ranked""")
def rankings_report(spark, sf_dir):
    ranks, queries, _ = _value_rankings(spark, sf_dir)
    return ranking.rankings_report(ranks, _named(queries), "orders")


@query("relevance_report", f"""WITH {_VALUE_SQL}
SELECT 'orders' AS dataset, query_id AS query_index, 'orders of ' || query_id AS query, table_id AS relevant
FROM (SELECT DISTINCT query_id FROM ranked) LEFT JOIN db_qrels USING (query_id)""")
def relevance_report(spark, sf_dir):
    _, queries, qrels = _value_rankings(spark, sf_dir)
    return ranking.relevance_report(_named(queries), qrels, "orders")


def _named(queries):
    return queries.withColumn("query", F.concat(F.lit("orders of "), "query_id"))


_COMPLETE_SQL = f"""WITH {_VALUE_SQL.replace(' QUALIFY rank <= 10', '')},
j AS (SELECT r.*, q.table_id IS NOT NULL AS hit FROM ranked r LEFT JOIN db_qrels q USING (query_id, table_id)),
p AS (
  SELECT query_id, coalesce(any_value(n), 0) AS n, sum(CASE WHEN hit THEN so_far / rank ELSE 0 END) AS ap_sum,
    min(CASE WHEN hit THEN rank END) AS first_hit
  FROM (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM j) LEFT JOIN gold USING (query_id) GROUP BY 1)
"""


def _complete(spark, sf_dir, metric: str):
    """An average over complete rankings: all orders of a customer, however many."""
    ranks, queries, qrels = _value_rankings(spark, sf_dir, depth=None)
    judged = ranking.judge(ranks, qrels).withColumn("dataset", F.lit("orders"))
    counted = ranking.relevant_counts(queries, qrels).withColumn("dataset", F.lit("orders"))
    return ranking.evaluate(judged, counted, [metric], keys=["dataset"])


@query("metric_map", _COMPLETE_SQL + "SELECT 'orders' AS dataset, round(coalesce(avg(CASE WHEN n > 0 THEN ap_sum / n END), 0), 6) AS map FROM p")
def metric_map(spark, sf_dir):
    return _complete(spark, sf_dir, "ap")


@query("metric_mrr", _COMPLETE_SQL + "SELECT 'orders' AS dataset, round(avg(coalesce(1.0 / first_hit, 0)), 6) AS mrr FROM p")
def metric_mrr(spark, sf_dir):
    return _complete(spark, sf_dir, "rr")


@query("evaluation_summary", f"""WITH {_VALUE_SQL},
j AS (SELECT r.*, q.table_id IS NOT NULL AS hit FROM ranked r LEFT JOIN db_qrels q USING (query_id, table_id)),
p AS (
  SELECT query_id, coalesce(any_value(n), 0) AS n,
    sum(CASE WHEN hit THEN so_far / rank ELSE 0 END) AS ap_sum, min(CASE WHEN hit THEN rank END) AS first_hit,
    sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg,
    count(CASE WHEN hit AND rank <= 5 THEN 1 END) AS h5, count(CASE WHEN hit THEN 1 END) AS h10
  FROM (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM j) LEFT JOIN gold USING (query_id) GROUP BY 1)
SELECT 'orders' AS dataset, round(coalesce(avg(CASE WHEN n > 0 THEN ap_sum / n END), 0), 6) AS map,
  round(avg(coalesce(1.0 / first_hit, 0)), 6) AS mrr_10,
  round(avg(CASE WHEN n = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, 1 + least(10, n)), lambda i: 1 / log2(i + 1))) END), 6) AS ndcg_10,
  round(avg(h5 / 5), 6) AS precision_5, round(avg(CASE WHEN n = 0 THEN 0 ELSE h5 / n END), 6) AS recall_5,
  round(avg(CASE WHEN n = 0 THEN 0 ELSE h10 / n END), 6) AS recall_10, round(avg((h10 >= n)::INT), 6) AS containment_10
FROM p""")
def evaluation_summary(spark, sf_dir):
    """Long relevance lists; some queries have none."""
    ranks, queries, qrels = _value_rankings(spark, sf_dir)
    judged = ranking.judge(ranks, qrels).withColumn("dataset", F.lit("orders"))
    counted = ranking.relevant_counts(queries, qrels).withColumn("dataset", F.lit("orders"))
    return ranking.evaluate(
        judged, counted, ["ap", "rr_10", "ndcg_10", "precision_5", "recall_5", "recall_10", "containment_10"],
        keys=["dataset"],
    )


_KIND_SQL = f"""WITH {sql_rankings(10, ('full', 'half'))},
orders_ranked AS (WITH {_VALUE_SQL} SELECT query_id, rank, table_id FROM ranked),
orders_gold AS (WITH {_VALUE_SQL} SELECT query_id, table_id FROM db_qrels),
r AS (
  SELECT 'vectors' AS dataset, query_id::VARCHAR AS query_id, rank, table_id::VARCHAR AS table_id FROM rankings WHERE model = 'full'
  UNION ALL SELECT 'halves', query_id::VARCHAR, rank, table_id::VARCHAR FROM rankings WHERE model = 'half'
  UNION ALL SELECT 'orders', query_id, rank, table_id FROM orders_ranked),
g AS (
  SELECT 'vectors' AS dataset, a.vec_id::VARCHAR AS query_id, b.vec_id::VARCHAR AS table_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  UNION ALL SELECT 'halves', query_id::VARCHAR, table_id::VARCHAR FROM rankings WHERE model = 'full' AND rank = 1
  UNION ALL SELECT DISTINCT 'orders', query_id, table_id FROM orders_gold),
q AS (SELECT DISTINCT dataset, CASE dataset WHEN 'vectors' THEN 'statement' WHEN 'halves' THEN 'question' ELSE 'schema question' END AS kind, query_id FROM r),
n AS (SELECT dataset, query_id, count(*) AS n FROM g GROUP BY 1, 2),
p AS (
  SELECT q.dataset, q.kind, q.query_id, coalesce(any_value(n.n), 0) AS n, min(CASE WHEN g.table_id IS NOT NULL THEN rank END) AS first_hit,
    coalesce(sum(CASE WHEN g.table_id IS NOT NULL THEN 1 / log2(rank + 1) END), 0) AS dcg,
    {', '.join(f'count(CASE WHEN g.table_id IS NOT NULL AND rank <= {k} THEN 1 END) AS h{k}' for k in (1, 5, 10))}
  FROM q JOIN r USING (dataset, query_id) LEFT JOIN g USING (dataset, query_id, table_id) LEFT JOIN n ON n.dataset = q.dataset AND n.query_id = q.query_id
  GROUP BY 1, 2, 3),
m AS (
  SELECT dataset, kind, {{'mrr_10': avg(coalesce(1.0 / first_hit, 0)),
    'ndcg_10': avg(CASE WHEN n = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, 1 + least(10, n)), lambda i: 1 / log2(i + 1))) END),
    {', '.join(f"'recall_{k}': avg(CASE WHEN n = 0 THEN 0 ELSE h{k} / n END), 'containment_{k}': avg((h{k} >= n)::INT)" for k in (1, 5, 10))},
    'precision_5': avg(h5 / 5), 'f1_5': avg(CASE WHEN n = 0 OR h5 = 0 THEN 0 ELSE 2 * (h5 / 5) * (h5 / n) / (h5 / 5 + h5 / n) END)}} AS s FROM p GROUP BY 1, 2),
long AS (
  {' UNION ALL '.join(f"SELECT dataset, kind, '{x}' AS metric, s.{x} AS value FROM m"
                      for x in ('mrr_10', 'ndcg_10', 'recall_1', 'recall_5', 'recall_10', 'containment_1', 'containment_5', 'containment_10', 'precision_5', 'f1_5'))})
SELECT dataset, kind, metric, round(value, 6) AS value FROM long
WHERE CASE WHEN metric[:11] = 'containment' THEN kind = 'schema question' WHEN metric IN ('precision_5', 'f1_5') THEN kind = 'statement' ELSE true END"""


@query("evaluation_by_kind", _KIND_SQL)
def evaluation_by_kind(spark, sf_dir):
    """Three datasets in one pass: statements (same label), questions (one table each), schema questions (several)."""
    text = lambda df, *cols: df.withColumns({c: F.col(c).cast("string") for c in cols})
    of = lambda df, dataset: df.withColumn("dataset", F.lit(dataset))
    ranks = written(text(model_rankings(spark, sf_dir, 10, ("full", "half")), "query_id", "table_id"), "rankings")
    full, half = (ranks.where(F.col("model") == m).select("query_id", "rank", "table_id") for m in ("full", "half"))
    value_ranks, value_queries, value_qrels = _value_rankings(spark, sf_dir)
    members = text(classes(spark, sf_dir), "id")
    judged = (
        of(ranking.judge_by_class(full, members), "vectors")
        .unionByName(of(ranking.judge(half, full.where("rank = 1").select("query_id", "table_id")), "halves"))
        .unionByName(of(ranking.judge(value_ranks, value_qrels), "orders"))
    )
    counted = (
        of(ranking.class_counts(members), "vectors")
        .unionByName(of(half.select("query_id").distinct().withColumn("n_relevant", F.lit(1).cast("bigint")), "halves"))
        .unionByName(of(ranking.relevant_counts(value_queries, value_qrels).select("query_id", "n_relevant"), "orders"))
    )
    kind = F.when(F.col("dataset") == "vectors", "statement").when(F.col("dataset") == "halves", "question").otherwise("schema question")
    found = ranking.evaluate_kinds(judged.withColumn("kind", kind), counted.withColumn("kind", kind))
    return found.select("dataset", "kind", F.explode("metrics").alias("metric", "value"))
