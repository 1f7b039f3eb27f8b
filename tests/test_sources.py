import io
import json
import tarfile

import pytest
from conftest import make_corpus
from pyspark.sql import functions as F

from tabscout.plans import file_fixtures, index_job
from tabscout.schemas import VECTOR_SCHEMA
from tabscout.sources import archive, files, folders, queries, registry, run_files, store, tables
from tabscout.streaming.vectors import ingest_vectors


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Databases with awkward files, one with broken JSON, one with the short catalogue only."""
    base = tmp_path_factory.mktemp("corpus")
    table = lambda file, cols=("a", "b"), **more: {"FILEPATH": file, "COLUMNS": list(cols), "COLUMN_DATATYPES": ["s"] * len(cols), **more}
    key = lambda parts, to: {"FOREIGN_KEY": parts, "REFERENCE_TABLE": to}
    put(base / "db1/info_full.json", json.dumps({"INFO": {"db_folder_name": "DB One", "x": 1}, "TABLES": {
        "Good Table": table("good.csv", NUM_ROWS=99, FOREIGN_KEYS=[key(["P1", "Ref Col"], " Other, T"), key(["P2"], "Good Table")]),
        "quoted": table("quoted.csv"), "ragged": table("ragged.csv"), "moved": table("moved.csv"),
        "empty": table("empty.csv"), "gone": table("gone.csv"), "bytes": table("bytes.csv"),
    }}))
    put(base / "db1/tables/good.csv", "a,b\n1,2\n3,4\n5,6\n7,8\n")
    put(base / "db1/tables/quoted.csv", 'a,b\n"x, ""y""\nz",2\n\n3,4\n')
    put(base / "db1/tables/ragged.csv", "a,b\n1\n2,3,4\n")
    put(base / "db1/tables/moved.csv", "b,c\n1,2\n")
    put(base / "db1/tables/empty.csv", "")
    put(base / "db1/tables/bytes.csv", b"a,b\n\xff,2\n")
    put(base / "db1/tables_with_ids/good.csv", "a,b\n9,9\n")
    put(base / "broken/info_full.json", "{not json")
    put(base / "short/info_short.json", json.dumps({"TABLES": {"_t": table("t.csv")}}))
    return str(base)


def test_databases(spark, root):
    assert sorted(r[0] for r in folders.databases(spark, root).collect()) == ["broken", "db1"]
    assert [r.folder for r in folders.rejected(spark, root).collect()] == ["broken"]


def test_read_folders(spark, root):
    got = {r.table_name: r for r in folders.read_folders(spark, root).collect()}
    assert set(got) == {"Good Table", "quoted", "ragged", "moved", "empty", "gone", "bytes"}
    assert got["Good Table"].rows == [["1", "2"], ["3", "4"], ["5", "6"]] and got["Good Table"].num_rows_total == 99
    assert got["quoted"].rows == [['x, "y"\nz', "2"], ["3", "4"]] and got["quoted"].num_rows_total == 2
    assert got["ragged"].rows == [["1", ""], ["2", "3"]]
    assert got["moved"].rows == [["", "1"]]  # by header name; what is not there is empty
    assert got["empty"].rows == [] and got["gone"].rows == [] and got["gone"].num_rows_total == 0
    assert got["bytes"].rows == [["�", "2"]]
    assert [tuple(k) for k in got["Good Table"].foreign_keys] == [("Ref Col", "P1", " Other, T"), ("", "P2", "Good Table")]


def test_row_limit_and_long_rows(spark, root):
    one = {r.table_name: r.rows for r in folders.read_folders(spark, root, row_limit=1).collect()}
    assert one["Good Table"] == [["1", "2"]]
    long = sorted((r.collection, r.row_idx, r.cells) for r in folders.csv_rows(spark, root).collect())
    assert [x[1:] for x in long if x[0] == "db1__good"] == [(i, {"a": str(2 * i + 1), "b": str(2 * i + 2)}) for i in range(4)]
    assert not any(x[0] == "db1__empty" for x in long)
    assert [x[2] for x in long if x[0] == "db1__ragged"] == [{"a": "1", "b": None}, {"a": "2", "b": "3"}]


def test_catalogues(spark, root):
    got = sorted(tuple(r) for r in folders.table_catalogue(spark, root).collect())
    assert ("DB One", "_good_table") in got and ("short", "_t") in got and len(got) == 8
    assert [tuple(r) for r in folders.fk_catalogue(spark, root).collect()] == [("DB One", "_good_table", "_other_t", "ref_col")]


def test_folders_round_trip(spark, tmp_path):
    corpus = make_corpus(spark, [
        (f"d{i % 3}", f"t{i}", ["a", "b"], [["x,y", '"q"'], ["", "é"]], ["t0"]) for i in range(9)
    ])
    rows = corpus.select("database_name", "filepath", "columns", F.posexplode("rows").alias("ord", "cells"))
    folders.write_folders(corpus, rows, str(tmp_path / "out"))
    back = folders.read_folders(spark, str(tmp_path / "out"))
    key = lambda df: sorted(repr(r.asDict(True)) for r in df.collect())
    assert key(back) == key(corpus.select(*back.columns))


TABLES = [
    {"table_id": "x", "header": ["a", "b"], "rows": [[1, 2], [3]]}, {"id": "y", "columns": ["a"], "data": [["p", "q"]]},
    {"columns": ["c"], "header": [], "rows": [["v"]]}, {"name": "skip", "header": ["a"], "rows": []},
]
WANT = {("x", ("a", "b"), (("1", "2"), ("3", None))), ("y", ("a",), (("p",),)), ("table_2", ("c",), (("v",),))}


def shape(df):
    return {(r.table_id, tuple(r.header), tuple(map(tuple, r.rows))) for r in df.collect()}


@pytest.mark.parametrize("text,name", [
    (json.dumps(TABLES), "tables.json"), (json.dumps({"tables": TABLES}), "tables.json"),
    ("\n".join(map(json.dumps, TABLES)), "t.jsonl"),
])
def test_table_containers(spark, tmp_path, text, name):
    put(tmp_path / name, text)
    dataset = registry.Dataset("my-db.v1", str(tmp_path / name), "tables_json")
    got = registry.load(spark, dataset)
    assert shape(got) == WANT
    assert {r.collection for r in got.collect()} == {"my_db_v1_x", "my_db_v1_y", "my_db_v1_table_2"}
    assert registry.load_summary(spark, [dataset]).first().documents == 3


def test_single_object_and_broken_json(spark, tmp_path):
    put(tmp_path / "one/a.json", json.dumps(TABLES[0]))
    put(tmp_path / "one/b.json", "{oops")
    assert {r.table_id for r in tables.normalise_tables(files.json_records(spark, str(tmp_path / "one")), "d").collect()} == {"x"}


def test_unknown_formats(spark):
    with pytest.raises(ValueError):
        registry.load(spark, registry.Dataset("d", "p", "nope"))
    with pytest.raises(ValueError):
        archive.read_archive_format(spark, "p", "nope")


def tar(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with tarfile.open(path, "w:gz") as t:
        for name, data in members:
            data = data if isinstance(data, bytes) else data.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_archives(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = io.BytesIO()
    pq.write_table(pa.table({"table_id": ["p1", "p2"], "table": [[["h"], ["1"]], [["h"]]]}), out)
    tar(tmp_path / "a.tar.gz", [
        ("d/tables.json", json.dumps([{"table_id": "own"}, {"z": 1}])), ("d/more.jsonl", '{"z": 2}\n\n{"table_id": "b"}\nbad\n'),
        ("d/broken_tables.json", "{oops"), ("d/readme.txt", "no"), ("d/corpus/train.parquet", out.getvalue()),
        ("w/databases/db/tables/t.csv", "a,b\n1,2\n3\n"), ("w/databases/db/tables_with_ids/t.csv", "a\n1\n"),
        ("j/x.json", '{"k": 1}'), ("j/metadata.json", '{"k": 2}'),
    ])
    root = str(tmp_path)
    made = tables.identify_tables(archive.read_archive_format(spark, root, "tables_json"), "db")
    assert sorted(r.table_id for r in made.collect()) == ["b", "db_table_1", "db_table_2", "own"]
    rows = archive.read_archive_format(spark, root, "folder_csv").withColumn("c", archive.collection_of()).collect()
    assert [(r.c, json.loads(r.record)) for r in rows] == [("db__t", {"a": "1", "b": "2"}), ("db__t", {"a": "3", "b": None})]
    splits = archive.read_archive_format(spark, root, "corpus_parquet").withColumn("c", archive.collection_of()).collect()
    assert [(r.c, json.loads(r.record)["table_id"]) for r in splits] == [("corpus_train", "p1"), ("corpus_train", "p2")]
    names = {r.member for r in archive.read_archive_format(spark, root, "folder_json").collect()}
    assert "j/x.json" in names and "j/metadata.json" not in names


def test_schema_documents(spark, tmp_path):
    put(tmp_path / "tables.json", json.dumps([{
        "db_id": "shop", "table_names": ["the orders", "nothing"], "table_names_original": ["orders", "void"],
        "column_names_original": [[-1, "*"], [0, "id"], [0, "total"]], "column_names": [[-1, "*"], [0, "i d"], [0, "t"]],
        "column_types": ["text", "number", "number"], "primary_keys": [1], "foreign_keys": [[1, 2]],
    }]))
    entries = tables.read_schema_json(spark, str(tmp_path / "tables.json"))
    got = tables.schema_documents(entries).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.database_id, r.table_id, r.table_name, r.table_name_original) == ("shop", "shop::orders", "the orders", "orders")
    assert r.table == [["id", "total"]] and r.column_types == ["number", "number"] and r.foreign_keys == [[1, 2]]


def test_splits_and_validation(spark, tmp_path):
    df = spark.createDataFrame([("t", bytearray(b"a\xff"))], "table_id string, raw binary")
    df.coalesce(1).write.parquet(str(tmp_path / "corpus/train.parquet"))
    got = tables.read_corpus_splits(spark, str(tmp_path)).first()
    assert got.collection == "corpus_train"
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("*.parquet"))
    put(tmp_path / "v/my-queries/validation.parquet", part.read_bytes())
    got = tables.read_validation(spark, str(tmp_path / "v")).first()
    assert got.raw == "a�" and got.collection == "my_queries_validation"


def test_query_sets(spark, tmp_path):
    put(tmp_path / "s.jsonl", '{"statement": "s0", "table_id": "a"}\n{"statement": "s1", "table_id": "b"}\n')
    q, rel = queries.read_statements(spark, str(tmp_path / "s.jsonl"))
    assert sorted(map(tuple, q.collect())) == [(0, "s0"), (1, "s1")] and sorted(map(tuple, rel.collect())) == [(0, "a"), (1, "b")]
    spark.createDataFrame([("x", "d", ["t", "t", "u"])], "question string, db_id string, gold_tables array<string>").write.parquet(str(tmp_path / "e"))
    q, rel = queries.read_schema_queries(spark, str(tmp_path / "e"))
    assert sorted(r.table_id for r in rel.collect()) == ["d::t", "d::u"] and q.first().query == "x"
    spark.createDataFrame([("x", "t")], "query string, table_id string").write.parquet(str(tmp_path / "p"))
    assert queries.read_query_parquet(spark, str(tmp_path / "p"))[1].first().table_id == "t"
    put(tmp_path / "b.jsonl", '{"query_id": "q1", "query": "x", "relevant_tables": ["a", "b"], "benchmark": "w"}\n')
    q, rel = queries.read_benchmark_queries(spark, str(tmp_path / "b.jsonl"))
    assert q.first().benchmark == "w" and rel.count() == 2


def test_run_files(spark, tmp_path):
    put(tmp_path / "m/a_metrics.json", json.dumps({"dataset": "d", "model": "m", "embeddings_count": 3, "extra": 1}))
    put(tmp_path / "m/summary.json", json.dumps({"dataset": "no"}))
    put(tmp_path / "m/b_metrics.json", "{oops")
    got = run_files.read_run_metrics(spark, str(tmp_path / "m"))
    assert [(r.dataset, r.embeddings_count, r.metrics_file) for r in got.collect()] == [("d", 3, "a_metrics.json")]
    run_files.write_report(got, str(tmp_path / "report"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "report"))
    assert back.columns == run_files.REPORT_COLUMNS and back.first().dataset == "d"
    put(tmp_path / "run1/metrics.csv", "epoch,train_loss,val_loss,learning_rate,best_val_loss,pearson,spearman,early_stopped,elapsed_seconds,timestamp\n1,0.5,0.4,1e-5,0.4,,,False,1.5,now\n")
    r = run_files.read_epoch_log(spark, str(tmp_path / "run1/metrics.csv")).first()
    assert (r.run, r.epoch, r.val_loss, r.early_stopped) == ("run1", 1, 0.4, False)


def points(spark, rows):
    return spark.createDataFrame([(p, "d", "m", "db", p, ["a"], n, "c", [0.5]) for p, n in rows], VECTOR_SCHEMA)


def stored(spark, path):
    return sorted((r.point_id, r.num_rows) for r in store.read_vectors(spark, path).collect())


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "vectors")
    twice = points(spark, [("a", 1)]).withColumn("seq", F.lit(1)).union(points(spark, [("a", 2), ("b", 3)]).withColumn("seq", F.lit(2)))
    store.write_vectors(twice, path, "seq")
    assert stored(spark, path) == [("a", 2), ("b", 3)]
    store.append_new(points(spark, [("b", 9), ("c", 4), ("c", 4)]), path)
    assert stored(spark, path) == [("a", 2), ("b", 3), ("c", 4)]
    store.append_new(points(spark, [("c", 4)]), path)
    assert len(stored(spark, path)) == 3
    store.append_new(points(spark, [("z", 1), ("z", 1)]), str(tmp_path / "fresh"))
    assert stored(spark, str(tmp_path / "fresh")) == [("z", 1)]
    other = points(spark, [("q", 7)]).withColumn("model", F.lit("m2"))
    store.overwrite_collections(other, path)
    assert len(stored(spark, path)) == 4


def test_stream_is_idempotent(spark, tmp_path):
    incoming, path, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for rows in ([("a", 1), ("b", 2)], [("b", 2), ("c", 3)]):
        points(spark, rows).write.mode("append").parquet(incoming)
        ingest_vectors(spark, incoming, path, progress).awaitTermination()
    assert stored(spark, path) == [("a", 1), ("b", 2), ("c", 3)]
    ingest_vectors(spark, incoming, path, str(tmp_path / "again")).awaitTermination()
    assert len(stored(spark, path)) == 3


def test_index_job(spark, tmp_path):
    docs = spark.createDataFrame([("d", "t", [["a"], ["1"], ["2"]]), ("d", "u", [["a"]]), ("d", "v", None), ("d", "w", [[], ["1"]])],
                                 "database_name string, table_id string, `table` array<array<string>>")
    r = index_job.build_index(docs, "d", "m", str(tmp_path / "v")).first()
    assert (r.embeddings_count, r.skipped_tables, r.embedding_dimension, r.embeddings_size_bytes) == (1, 3, 64, 256)
    assert r.throughput_embeddings_per_sec > 0
    simple = index_job.points(docs, "d", "m", simple=True).collect()
    assert len(simple) == 1 and simple[0].num_rows == 2


def test_archive_writer_bounds_members(spark, tmp_path):
    df = spark.range(50).select((F.col("id") % 2).alias("archive"), F.col("id").alias("name"),
                                F.to_json(F.struct(F.col("id").alias("table_id"))).alias("record"))
    file_fixtures.write_archives(df, str(tmp_path), member_records=7)
    got = archive.read_archive_format(spark, str(tmp_path), "tables_json")
    assert got.count() == 50 and got.groupBy("archive", "member").count().agg(F.max("count")).first()[0] <= 7


def test_plain_archives_are_read_by_many_tasks(spark, tmp_path):
    def plain(name, mode):
        with tarfile.open(tmp_path / name, mode) as t:
            for i in range(40):
                data = "".join(json.dumps({"table_id": f"{i}-{k}"}) + "\n" for k in range(5)).encode()
                info = tarfile.TarInfo(f"d/part{i}.jsonl" if i % 2 else f"d/other{i}.txt")
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))

    plain("big.tar", "w:")
    plain("same.tar.gz", "w:gz")
    plain("disguised.tar", "w:gz")
    put(tmp_path / "cut.tar", (tmp_path / "big.tar").read_bytes()[:9000])
    root = str(tmp_path)
    got = archive.read_archives(spark, root, ["*.jsonl"])
    of = lambda name: sorted((r.member_no, r.member, r.idx, r.record) for r in got.where(F.col("archive").endswith("/" + name)).collect())
    assert len(of("big.tar")) == 100 and of("big.tar") == of("same.tar.gz") == of("disguised.tar")
    assert set(of("cut.tar")) < set(of("big.tar"))
    index = archive.member_index(spark, root, ["*.jsonl"]).where(F.col("archive").endswith("/big.tar"))
    assert index.count() == 20 and {r.length for r in index.collect()} != {0}
    tasks = got.where(F.col("archive").endswith("/big.tar")).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1
    assert [r.archive.rsplit("/", 1)[1] for r in archive.archive_errors(spark, root, ["*.jsonl"]).collect()] == ["cut.tar"]


def test_what_cannot_be_read_is_told(spark, tmp_path):
    tar(tmp_path / "a.tar.gz", [("d/broken_tables.json", "{oops"), ("d/tables.json", '[{"table_id": "x"}]')])
    put(tmp_path / "cut.tar.gz", (tmp_path / "a.tar.gz").read_bytes()[:60])
    root = str(tmp_path)
    errors = {(r.archive.rsplit("/", 1)[1], r.member): r.error for r in archive.archive_errors(spark, root, ["*.json"]).collect()}
    assert set(errors) == {("a.tar.gz", "d/broken_tables.json"), ("cut.tar.gz", None)} and all(errors.values())
    assert [r.member for r in archive.read_archives(spark, root, ["*.json"]).collect()] == ["d/tables.json"]
    put(tmp_path / "db/tables/long.csv", "a\n" + "x" * 200_000 + "\n")  # over the limit of one CSV field
    put(tmp_path / "db/tables/fine.csv", "a\n1\n")
    assert [(r.database_name, r.file) for r in folders.unreadable(spark, root).collect()] == [("db", "long.csv")]
    heads = {r.file: (r.header, r.error is None) for r in folders.csv_heads(spark, root).collect()}
    assert heads == {"long.csv": (["a"], False), "fine.csv": (["a"], True)}


def test_only_named_collections_are_read(spark, tmp_path):
    path = str(tmp_path / "vectors")
    columns = "point_id string, dataset string, model string, num_rows long"
    first = spark.createDataFrame([("p", "d1", "m", 1), ("p", "d2", "m", 1)], columns)
    store.append_new(first, path)
    batch = spark.createDataFrame([("p", "d1", "m", 2), ("q", "d1", "m", 2)], columns)
    plan = store.stored_for(batch, path)._jdf.queryExecution().executedPlan().toString()
    assert "d1" in plan[plan.index("PartitionFilters"):] and "d2" not in plan
    store.append_new(batch, path)
    got = spark.read.parquet(path).select("dataset", "point_id", "num_rows").collect()
    assert sorted(map(tuple, got)) == [("d1", "p", 1), ("d1", "q", 2), ("d2", "p", 1)]


def test_listing_does_not_pass_through_the_driver(spark, tmp_path):
    for name in ("a.csv", "deep/er/b.csv", "deep/c.txt", "_hidden/d.csv", ".e.csv", "_f.csv", "_k=1/g.csv", "sp ace/h é.csv", "deep/i.csv._COPYING_"):
        put(tmp_path / name, "x")
    listed = lambda glob: sorted(r.path for r in files.list_files(spark, str(tmp_path), glob).collect())
    for glob in ("*.csv", "*.{csv,txt}", "[a-b].csv", "?.csv", "c.txt", "none"):
        assert listed(glob) == sorted(r.path for r in files._spark_listing(spark, str(tmp_path), glob).collect())
    assert not files.list_files(spark, str(tmp_path), "*.csv").inputFiles()  # Spark's own listing is held by the driver
    assert [r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path / "a.csv"), "*.csv").collect()] == ["a.csv"]
    assert len(files.list_files(spark, f"{tmp_path}/*/c.txt", "*").collect()) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.list_files(spark, str(tmp_path / "gone"), "*.csv").collect()
