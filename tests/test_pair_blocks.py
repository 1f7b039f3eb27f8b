"""Pair texts from blocks equal the listed pairs, and the file grows with the corpus."""
import pytest

from conftest import make_corpus
from tabscout.operators import samples
from tabscout.sources import pair_blocks


@pytest.mark.parametrize("block_tables", [512, 7, 1])
def test_blocks_give_every_pair_once(spark, tmp_path, monkeypatch, block_tables):
    tables = [(f"db{d}", f"t{t}", ["c"], [[f"{d}-{t}"]], []) for d, n in enumerate([30, 1, 2, 8]) for t in range(n)]
    corpus = make_corpus(spark, [*tables, ("db0", "none", ["c"], [], [])])
    path = str(tmp_path / "blocks")
    pair_blocks.write_pair_blocks(corpus, path, block_tables=block_tables)
    got = [tuple(r) for r in pair_blocks.read_pairs(spark, path).collect()]
    listed = samples.all_pairs(samples.index(corpus)).selectExpr("database_name db_a", "table_a", "database_name db_b", "table_b", "label")
    want = [tuple(r) for r in samples.pair_texts(corpus, listed).select("db_a", "table_a", "db_b", "table_b", "label", "text_a", "text_b").collect()]
    assert sorted(got) == sorted(want) and len(got) == 435 + 1 + 28
    stored = spark.read.parquet(path)
    assert stored.selectExpr("sum(size(texts))").first()[0] == 40  # each text once


def test_no_pairs(spark, tmp_path):
    corpus = make_corpus(spark, [("a", "t", ["c"], [["1"]], [])])
    pair_blocks.write_pair_blocks(corpus, str(tmp_path / "b"))
    assert pair_blocks.read_pairs(spark, str(tmp_path / "b")).count() == 0
