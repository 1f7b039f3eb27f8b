import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabscout.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_corpus(spark, tables):
    """tables: (db, table, columns, rows, [fk targets])"""
    from tabscout.schemas import CORPUS_SCHEMA

    rows = [
        (db, t, cols, ["string"] * len(cols), data, [("c", "P", k) for k in fks], f"{t}.csv", len(data))
        for db, t, cols, data, fks in tables
    ]
    return spark.createDataFrame(rows, CORPUS_SCHEMA)
