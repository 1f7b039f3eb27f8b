import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry

FAST = [
    "view_full", "view_combined_sniffed", "content_ids", "pc_positive_pairs", "tc_triplets", "mlm_masking",
    "topk_cosine", "topk_ann", "similar_tables", "evaluation_summary", "epoch_progress", "run_rollup", "pivot_throughput",
]


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: tuple(map(clean, v)) if isinstance(v, (list, tuple)) else (0.0 if v == 0 else v)
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    from tabscout.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and 0 < rows[0].map < 1


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


def test_every_positive_pair_is_listed_with_texts(spark):
    test_query_equals_sql(spark, "pc_positive_pair_texts")
    space = entry.queries()["pc_pair_space"](spark, SF).agg({"n_pairs": "sum"}).first()[0]
    assert entry.queries()["pc_positive_pair_texts"](spark, SF).count() == space > 0
