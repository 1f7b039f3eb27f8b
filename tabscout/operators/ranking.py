"""Ranking quality: rankings against what is relevant.

Metrics read *judged* rankings (query_id, rank, table_id, hit) and the list of queries with their
number of relevant tables; both may carry extra grouping keys such as the model.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

DIGITS = 6


def judge(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """Mark hits from long relevance lists qrels(query_id, table_id)."""
    gold = qrels.select("query_id", "table_id").distinct().withColumn("_gold", F.lit(True))
    return rankings.join(gold, ["query_id", "table_id"], "left").withColumn(
        "hit", F.col("_gold").isNotNull()
    ).drop("_gold")


def relevant_counts(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """queries(query_id, ...) with n_relevant, 0 where there is no relevance list."""
    n = qrels.select("query_id", "table_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return queries.join(n, "query_id", "left").withColumn("n_relevant", F.coalesce("_n", F.lit(0))).drop("_n")


def judge_by_class(rankings: DataFrame, classes: DataFrame) -> DataFrame:
    """Mark hits where query and table share a class, without listing all pairs of a class."""
    own = classes.select(F.col("id").alias("query_id"), F.col("class").alias("_q"))
    other = classes.select(F.col("id").alias("table_id"), F.col("class").alias("_t"))
    return rankings.join(own, "query_id").join(other, "table_id").withColumn(
        "hit", F.col("_q") == F.col("_t")
    ).drop("_q", "_t")


def class_counts(classes: DataFrame, without_self: bool = True) -> DataFrame:
    """(query_id, n_relevant): other members of the query's class."""
    sizes = classes.groupBy("class").agg((F.count(F.lit(1)) - int(without_self)).alias("n_relevant"))
    return classes.join(sizes, "class").select(F.col("id").alias("query_id"), "n_relevant")


def _gain(position) -> Column:
    return 1.0 / F.log2(position + 1)


def per_query(
    judged: DataFrame, queries: DataFrame, keys: Sequence[str] = (), ks: Sequence[int] = (1, 5, 10),
    ndcg_ks: Sequence[int] = (10,), mrr_k: int | None = None, ap: bool = True,
) -> DataFrame:
    """One row per query with every metric; queries without a ranking stay with zeros.

    Average precision is null for queries without relevant tables (they are skipped in MAP).
    """
    q = [*keys, "query_id"]
    hits = judged.filter("hit").withColumn("rank", F.col("rank").cast("bigint"))
    ideal = lambda k: F.aggregate(
        F.when(F.least(F.lit(k), "n_relevant") > 0, F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int"))))
        .otherwise(F.array().cast("array<int>")),
        F.lit(0.0), lambda s, i: s + _gain(i),
    )
    aggs = [F.min("rank").alias("first_hit")]
    for k in ndcg_ks:
        aggs.append(F.sum(F.when(F.col("rank") <= k, _gain(F.col("rank")))).alias(f"_dcg{k}"))
    for k in ks:  # at most k distinct ids are kept per query
        aggs.append(F.size(F.collect_set(F.when(F.col("rank") <= k, F.col("table_id")))).alias(f"_hits{k}"))
    if ap:
        # the n-th hit at rank r adds n / r; a query's hits are as many as its ranking is deep
        nth = F.row_number().over(Window.partitionBy(*q).orderBy("rank"))
        hits = hits.withColumn("_precision", nth / F.col("rank"))
        aggs.append(F.sum("_precision").alias("_precision"))
    found = hits.groupBy(*q).agg(*aggs)
    n = F.col("n_relevant")
    out = queries.join(found, q, "left")
    cols: list[Column] = [*map(F.col, q), n]
    if ap:
        cols.append(F.when(n > 0, F.coalesce("_precision", F.lit(0.0)) / n).alias("ap"))
    cols.append(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("rr"))
    if mrr_k:
        cols.append(F.when(F.col("first_hit") <= mrr_k, 1.0 / F.col("first_hit")).otherwise(0.0).alias(f"rr_{mrr_k}"))
    for k in ndcg_ks:
        cols.append(F.coalesce(F.try_divide(F.col(f"_dcg{k}"), ideal(k)), F.lit(0.0)).alias(f"ndcg_{k}"))
    for k in ks:
        got = F.coalesce(f"_hits{k}", F.lit(0))
        p, r = got / F.lit(k), F.when(n > 0, got / n).otherwise(0.0)
        cols += [
            p.alias(f"precision_{k}"), r.alias(f"recall_{k}"),
            F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias(f"f1_{k}"),
            (got >= n).cast("double").alias(f"containment_{k}"),
        ]
    return out.select(*cols)


_NAMES = {"ap": "map", "rr": "mrr"}


def averages(scored: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean of per-query metrics; the mean of nothing is 0."""
    aggs = []
    for m in metrics:
        name = _NAMES.get(m, m.replace("rr_", "mrr_") if m.startswith("rr_") else m)
        aggs.append(F.round(F.coalesce(F.avg(m), F.lit(0.0)), DIGITS).alias(name))
    return scored.groupBy(*keys).agg(*aggs)


def evaluate(
    judged: DataFrame, queries: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Averages of the named metrics, computing only what they need."""
    def cutoffs(*kinds):
        named = [m.rpartition("_") for m in metrics]
        return sorted({int(k) for kind, _, k in named if kind in kinds})

    mrr = cutoffs("rr")
    scored = per_query(
        judged, queries, keys, ks=cutoffs("precision", "recall", "f1", "containment"),
        ndcg_ks=cutoffs("ndcg"), mrr_k=mrr[0] if mrr else None, ap="ap" in metrics,
    )
    return averages(scored, metrics, keys)


_BASIC = ("recall_1", "recall_5", "recall_10", "rr_10", "ndcg_10")
# what is reported for a dataset, by the kind of its queries
KIND_METRICS = {
    "question": _BASIC,
    "statement": (*_BASIC, "precision_5", "f1_5"),
    "schema question": (*_BASIC, "containment_1", "containment_5", "containment_10"),
}


def evaluate_kinds(judged: DataFrame, queries: DataFrame, metrics_of: dict[str, Sequence[str]] = KIND_METRICS) -> DataFrame:
    """(dataset, kind, metrics): several datasets in one pass, each with the metrics of its kind as a map.

    Both inputs carry ``dataset`` and ``kind``.
    """
    keys = ["dataset", "kind"]
    every = sorted({m for metrics in metrics_of.values() for m in metrics})
    means = averages(per_query(judged, queries, keys, ks=(1, 5, 10), ndcg_ks=(10,), mrr_k=10, ap=False), every, keys)
    shown = {m: _NAMES.get(m, m.replace("rr_", "mrr_") if m.startswith("rr_") else m) for m in every}
    pairs = lambda metrics: F.create_map(*[x for m in sorted(metrics) for x in (F.lit(shown[m]), F.col(shown[m]))])
    chosen = F.lit(None).cast("map<string,double>")
    for kind, metrics in metrics_of.items():
        chosen = F.when(F.col("kind") == kind, pairs(metrics)).otherwise(chosen)
    return means.select(*keys, chosen.alias("metrics"))


# model-name keywords of the architecture report (fixed values)
_DECODERS = "qwen|mistral|decoder|e5-|bge"


def with_architecture(report: DataFrame, model: str = "model") -> DataFrame:
    name = F.lower(F.col(model))
    known = name.rlike(_DECODERS)
    hybrid = known & name.contains("bge")
    return (
        report
        .withColumn("architecture", F.when(hybrid, "Hybrid").when(known, "Decoder-Only").otherwise("Bidirectional"))
        .withColumn("parameters", F.when(hybrid, "335M").when(known, "7B").otherwise("110M"))
        .withColumn("place", F.when(hybrid, 2).when(known, 1).otherwise(3))
    )


def rankings_report(rankings: DataFrame, queries: DataFrame, dataset: str) -> DataFrame:
    """Output rows of a ranking run; the relevant tables are a table of their own."""
    return rankings.join(queries.select("query_id", "query"), "query_id").select(
        F.lit(dataset).alias("dataset"), F.col("query_id").alias("query_index"), "query", "rank",
        F.col("table_id").alias("retrieved_table"),
    )


def relevance_report(queries: DataFrame, qrels: DataFrame, dataset: str) -> DataFrame:
    """One row per query and relevant table; a query without any has one row with a null table."""
    gold = qrels.select("query_id", "table_id").distinct()
    return queries.select("query_id", "query").join(gold, "query_id", "left").select(
        F.lit(dataset).alias("dataset"), F.col("query_id").alias("query_index"), "query", F.col("table_id").alias("relevant"),
    )
