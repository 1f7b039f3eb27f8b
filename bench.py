"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabscout.plans import catalog  # noqa: E402
from tabscout.session import build_session  # noqa: E402

HEADLINE = [
    "view_schema", "view_row", "view_full", "hash_encode", "mean_pool", "topk_cosine", "topk_cosine_cells",
    "topk_ann_recall", "topk_text", "similar_tables", "table_retrieval", "report_adhoc", "pc_pairs", "tc_triplets",
    "tc_sb_batches", "mlm_masking_documents", "loss_triplet", "similarity_correlation", "epoch_progress",
    "run_rollup", "pivot_throughput", "prefix_join", "index_job", "incremental_upsert", "corpus_tables",
]


def timed(make) -> float:
    make().write.format("noop").mode("overwrite").save()  # warm
    started = time.time()
    make().write.format("noop").mode("overwrite").save()
    return time.time() - started


def against_baseline(spark, sf_dir: str) -> dict[str, float]:
    from tabscout.functions import views
    from tabscout.operators import encode, samples
    from tabscout.plans import vector_queries
    from tabscout.plans.corpora import stored_corpus

    corpus = stored_corpus(spark, sf_dir)
    n = corpus.count()
    out = {"tables": n}
    for view in ("schema", "row", "full"):
        out[f"{view}_view_ms_per_table"] = round(1000 * timed(lambda: corpus.select(views.serialize(view))) / n, 5)
    texts = corpus.select("table_name", views.serialize("full").alias("text"))
    out["encode_tables_per_sec"] = round(n / timed(lambda: encode.encode_hashed(texts).select("table_name", "embedding")))
    out["triplets_per_sec"] = round(10_000 / timed(lambda: samples.triplets(corpus, 10_000)))
    vectors = vector_queries.model_vectors(spark, sf_dir).count()
    top = timed(lambda: vector_queries.topk_cosine(spark, sf_dir))
    out["exact_top10_ms_per_query"] = round(1000 * top / vectors, 4)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        started = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    extra = {} if sys.argv[1:] else {"baseline": against_baseline(spark, sf_dir)}
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), **extra,
    }))


if __name__ == "__main__":
    main()
