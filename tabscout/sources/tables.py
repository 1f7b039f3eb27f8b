"""Table documents from JSON records and Parquet files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabscout.functions.names import collection_name
from tabscout.operators.numbering import number_within

_TABLE = (
    "table_id string, _id string, id string, name string, header array<string>, columns array<string>, "
    "column_names array<string>, rows array<array<string>>, data array<array<string>>"
)


def _filled(*arrays: str) -> Column:
    """The first of the arrays that is not empty."""
    return F.coalesce(*[F.when(F.size(a) > 0, F.col(a)) for a in arrays])


def normalise_tables(records: DataFrame, db: str) -> DataFrame:
    """Records(idx, record) of any of the container shapes -> (table_id, collection, header, rows).

    Names and rows are looked for under their alternatives; tables without either are skipped.
    Short rows are padded with nulls, long ones cut to the header.
    """
    t = records.select("idx", F.from_json("record", _TABLE).alias("t")).select("idx", "t.*")
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    table_id = F.coalesce(
        named("table_id"), named("id"), named("name"), F.concat(F.lit("table_"), F.col("idx").cast("string"))
    )
    found = t.select(
        table_id.alias("table_id"), _filled("header", "columns", "column_names").alias("header"),
        _filled("rows", "data").alias("rows"),
    ).filter(F.col("header").isNotNull() & F.col("rows").isNotNull())
    padded = F.transform("rows", lambda r: F.transform("header", lambda c, i: F.get(r, i)))
    return found.select(
        "table_id", collection_name(F.lit(db), F.col("table_id")).alias("collection"), "header", padded.alias("rows")
    )


def identify_tables(records: DataFrame, db: str) -> DataFrame:
    """Raw records of an archive with a table id: their own, else ``{db}_table_{n}`` by their place
    in the whole archive. Unparsable lines are dropped."""
    own = F.from_json("record", "table_id string, _id string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    placed = number_within(records, ["archive"], F.col("member_no"), ["idx"], "place")
    return (
        placed.withColumn("_t", own).filter(F.col("_t._bad").isNull())
        .select(
            "archive", "member",
            F.coalesce("_t.table_id", "_t._id", F.concat(F.lit(f"{db}_table_"), F.col("place").cast("string"))).alias("table_id"),
            "record",
        )
    )


SCHEMA_JSON = (
    "db_id string, table_names array<string>, table_names_original array<string>, "
    "column_names array<array<string>>, column_names_original array<array<string>>, column_types array<string>, "
    "primary_keys array<string>, foreign_keys array<array<int>>"
)


def read_schema_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per database entry of a schema file."""
    return spark.read.schema(SCHEMA_JSON).option("multiLine", "true").json(path)


def schema_documents(entries: DataFrame) -> DataFrame:
    """One header-only table document per table of each database entry, built inside the row.

    Columns are grouped by their table index; index -1 and tables without columns are dropped.
    """
    original = F.coalesce(_filled("table_names_original"), F.col("table_names"))
    shown = F.coalesce(_filled("table_names"), F.col("table_names_original"))
    pairs = F.coalesce(_filled("column_names_original"), F.col("column_names"))
    columns = F.transform(
        pairs, lambda p, i: F.struct(
            F.get(p, 0).cast("int").alias("t"), F.get(p, 1).alias("name"), F.get("column_types", i).alias("type")
        ),
    )
    of_table = lambda i: F.filter("_columns", lambda c: c["t"] == i)
    docs = F.transform(
        "_names",
        lambda name, i: F.struct(
            name.alias("table_name_original"), F.coalesce(F.get("_shown", i), name).alias("table_name"),
            of_table(i).alias("c"),
        ),
    )
    return (
        entries.withColumn("_names", original).withColumn("_shown", shown).withColumn("_columns", columns)
        .select("db_id", "primary_keys", "foreign_keys", F.explode(docs).alias("d"))
        .filter(F.size("d.c") > 0)
        .select(
            F.col("db_id").alias("database_id"), F.concat_ws("::", "db_id", "d.table_name_original").alias("table_id"),
            "d.table_name", "d.table_name_original",
            F.transform("d.c", lambda c: c["type"]).alias("column_types"), "primary_keys", "foreign_keys",
            F.array(F.transform("d.c", lambda c: c["name"])).alias("table"),
        )
    )


def read_corpus_splits(spark: SparkSession, root: str) -> DataFrame:
    """Table documents of ``corpus/*.parquet`` with the collection each split belongs to."""
    split = F.regexp_extract("_metadata.file_path", r"corpus/([^/]+?)(?:\.parquet)?(?:/[^/]+)?$", 1)
    df = spark.read.parquet(f"{root.rstrip('/')}/corpus/*.parquet")
    return df.select("*", F.concat(F.lit("corpus_"), split).alias("collection"))


def read_validation(spark: SparkSession, root: str) -> DataFrame:
    """Rows of every ``validation.parquet`` below a folder, named after the parent folder.

    Bytes become text with malformed sequences replaced.
    """
    df = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "validation.parquet")
        .option("mergeSchema", "true").parquet(root)
    )
    parent = F.regexp_extract("_metadata.file_path", r"([^/]+)/validation\.parquet$", 1)
    plain = [
        F.make_valid_utf8(F.col(f"`{f.name}`").cast("string")).alias(f.name) if f.dataType.typeName() == "binary"
        else F.col(f"`{f.name}`") for f in df.schema.fields
    ]
    return df.select(*plain, F.translate(F.concat(parent, F.lit("_validation")), "-.", "__").alias("collection"))
