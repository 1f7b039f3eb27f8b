"""Contrastive samples: pairs, triplets and texts, drawn by hash instead of a driver loop.

Every draw is an equi-join on an ordinal. Ids are joined first, texts are attached last.
"""
from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscout.functions.hashing import h, pick, pick_other
from tabscout.functions.views import fan_out, serialize
from tabscout.operators.numbering import buckets_for, hash_bucket, number_sorted, number_within
from tabscout.session import written


def nonempty(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.size("rows") > 0)


def first_databases(corpus: DataFrame, n: int) -> DataFrame:
    """Tables of the first n databases in name order (n is the caller's bound)."""
    kept = corpus.select("database_name").distinct().orderBy("database_name").limit(n)
    return corpus.join(kept, "database_name", "left_semi")


class Index(NamedTuple):
    """databases(database_name, db_ord, n_tables), tables(database_name, table_name, tab_ord, n_tables)."""

    databases: DataFrame
    tables: DataFrame


def index(corpus: DataFrame) -> Index:
    """Databases, and the non-empty tables inside each, numbered in the order of their hash.

    Ids are read from the corpus once and stored, and so are both results: every draw looks them
    up several times.
    """
    hashed = written(nonempty(corpus).select("database_name", "table_name").withColumn(
        "_h", h(F.col("database_name"), F.col("table_name"))
    ), "table-ids")
    buckets = buckets_for(hashed.count())
    tables = written(
        number_within(
            hashed, ["database_name"], hash_bucket(F.col("_h"), buckets), ["_h", "table_name"], "tab_ord", size="n_tables"
        ).drop("_h"),
        "tables",
    )
    one_each = tables.filter(F.col("tab_ord") == 0).select(
        "database_name", "n_tables", h(F.col("database_name")).alias("_h")
    )
    databases = number_within(
        one_each, [], hash_bucket(F.col("_h"), buckets), ["_h", "database_name"], "db_ord"
    ).drop("_h")
    return Index(written(databases, "databases"), tables)


def fk_edges(corpus: DataFrame) -> DataFrame:
    return corpus.select(
        "database_name", "table_name", F.posexplode("foreign_keys").alias("pos", "fk")
    ).select("database_name", "table_name", "pos", "fk.*")


def fk_targets(corpus: DataFrame) -> DataFrame:
    """References whose target exists in the same database; repeated edges stay."""
    present = corpus.select("database_name", F.col("table_name").alias("reference_table"))
    return fk_edges(corpus).join(present, ["database_name", "reference_table"])


def fk_lists(corpus: DataFrame) -> DataFrame:
    """(database_name, table_name, targets): non-empty targets of a table, one array per table row."""
    return (
        fk_targets(nonempty(corpus)).groupBy("database_name", "table_name")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "reference_table"))).alias("_t"))
        .select("database_name", "table_name", F.transform("_t", lambda t: t["reference_table"]).alias("targets"))
    )


# --- pairs ------------------------------------------------------------------------------------

def pair_ranges(ix: Index, label: float = 0.5) -> DataFrame:
    """All unordered same-database pairs, held as one range of partner ordinals per table.

    A database of n tables has n(n-1)/2 pairs; this states every one of them in n rows.
    """
    last = F.col("n_tables") - 1
    return ix.tables.select(
        "database_name", "table_name", "tab_ord",
        (F.col("tab_ord") + 1).alias("first_partner"), last.alias("last_partner"),
        (last - F.col("tab_ord")).alias("n_pairs"), F.lit(label).alias("label"),
    )


def pair_space(corpus: DataFrame, label: float = 0.5) -> DataFrame:
    return pair_ranges(index(corpus), label)


def pairs_of(ix: Index, anchors: DataFrame, label: float = 0.5) -> DataFrame:
    """Every same-database pair of the chosen anchors(database_name, table_name), listed."""
    left = anchors.select("database_name", F.col("table_name").alias("table_a"))
    right = ix.tables.select("database_name", F.col("table_name").alias("table_b"))
    return left.join(right, "database_name").where("table_a <> table_b").select(
        "database_name", "table_a", "table_b", F.lit(label).alias("label"))


def all_pairs(ix: Index, label: float = 0.5) -> DataFrame:
    """Every same-database pair, the table with the lower ordinal first.

    Each table is its own anchor and lists the ordinals after it, which are then looked up, so a large
    database is as many keys as it has tables.
    """
    left = ix.tables.where("tab_ord < n_tables - 1").select(
        "database_name", F.col("table_name").alias("table_a"),
        F.explode(F.sequence(F.col("tab_ord") + 1, F.col("n_tables") - 1)).alias("tab_ord"))
    right = ix.tables.select("database_name", "tab_ord", F.col("table_name").alias("table_b"))
    return left.join(right, ["database_name", "tab_ord"]).select("database_name", "table_a", "table_b", F.lit(label).alias("label"))


def positive_pairs(
    ix: Index, partners_per_table: int | None = None, seed: int = 42, label: float = 0.5
) -> DataFrame:
    """Same-database pairs (database_name, table_a, table_b, label).

    Tables of a database stand in a ring; a step d from 1 to n div 2 pairs each table with the one
    d places on, so that all steps together give each unordered pair once. With
    ``partners_per_table`` that many steps are taken per database (fewer if the database has
    fewer), else all of them, which is quadratic in the size of a database. No join key is hot:
    each table is the partner of as many tables as it has partners.
    """
    n, own = F.col("n_tables"), F.col("tab_ord")
    steps = F.floor(n / 2)
    taken = steps if partners_per_table is None else F.least(steps, F.lit(partners_per_table))
    start = pick(steps, seed, F.col("database_name"), "step")
    anchors = (
        ix.tables.filter(steps > 0)
        .select(
            "database_name", F.col("table_name").alias("table_a"), "tab_ord", "n_tables",
            F.explode(F.transform(F.sequence(F.lit(0), taken - 1), lambda t: 1 + (start + t) % steps)).alias("step"),
        )
        # half-way round an even ring both ends name the same pair
        .filter((F.col("step") * 2 < n) | (own * 2 < n))
        .withColumn("partner", (own + F.col("step")) % n)
    )
    partners = ix.tables.select(
        "database_name", F.col("table_name").alias("table_b"), F.col("tab_ord").alias("partner")
    )
    return anchors.join(partners, ["database_name", "partner"]).select(
        "database_name", "table_a", "table_b", F.lit(label).alias("label")
    )


def negative_pairs(ix: Index, seed: int = 42, negatives_per_db: int = 1, label: float = 0.0) -> DataFrame:
    """Per database: one of its tables with a table of another database."""
    dbs, tables = ix
    n_dbs = dbs.agg(F.count(F.lit(1))).scalar()
    others = dbs.select(
        F.col("db_ord").alias("other_ord"), F.col("database_name").alias("other_db"),
        F.col("n_tables").alias("other_n"),
    )
    db = F.col("database_name")
    drawn = (
        dbs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(negatives_per_db - 1))))
        .withColumn("_n", n_dbs)
        .withColumn("tab_ord", pick(F.col("n_tables"), seed, db, F.col("draw"), "anchor"))
        .withColumn("other_ord", pick_other(F.col("_n"), F.col("db_ord"), seed, db, F.col("draw"), "other"))
        .join(others, "other_ord")
        .withColumn("other_tab", pick(F.col("other_n"), seed, db, F.col("draw"), "negative"))
    )
    a = tables.select("database_name", "tab_ord", F.col("table_name").alias("table_a"))
    b = tables.select(
        F.col("database_name").alias("other_db"), F.col("tab_ord").alias("other_tab"),
        F.col("table_name").alias("table_b"),
    )
    return drawn.join(a, ["database_name", "tab_ord"]).join(b, ["other_db", "other_tab"]).select(
        "database_name", "table_a", "other_db", "table_b", F.lit(label).alias("label")
    )


def pairs(corpus: DataFrame, seed: int = 42) -> DataFrame:
    """All training pairs: positives as ranges of partners, negatives one by one.

    (db_a, table_a, db_b, table_b, first_partner, last_partner, n_pairs, label): a row with a
    table_b is that pair, any other row is the pairs with the tables of the stated ordinals.
    """
    ix = index(corpus)
    db, none = F.col("database_name"), F.lit(None)
    pos = pair_ranges(ix).where("n_pairs > 0").select(
        db.alias("db_a"), F.col("table_name").alias("table_a"), db.alias("db_b"), none.cast("string").alias("table_b"),
        "first_partner", "last_partner", "n_pairs", "label")
    neg = negative_pairs(ix, seed).select(
        db.alias("db_a"), "table_a", F.col("other_db").alias("db_b"), "table_b", none.cast("bigint").alias("first_partner"),
        none.cast("bigint").alias("last_partner"), F.lit(1).cast("bigint").alias("n_pairs"), "label")
    return pos.unionByName(neg)


def pair_texts(corpus: DataFrame, listed: DataFrame, view: str = "row") -> DataFrame:
    """text_a and text_b beside listed pairs (db_a, table_a, db_b, table_b, ...)."""
    texts = fan_out(nonempty(corpus), [view])
    return with_texts(listed, texts, {
        "text_a": ("db_a", "table_a", F.lit(view)), "text_b": ("db_b", "table_b", F.lit(view)),
    })


def shuffled(df: DataFrame, ids: list[str], seed: int = 42, name: str = "position") -> DataFrame:
    """Position of each row in a seeded shuffle. Rows are found by hash range, so no task sorts all.

    Reads ``df`` three times (its size, the size of the ranges, the rows): store it first.
    """
    hashed = df.withColumn("_h", h(seed, *[F.col(c) for c in ids]))
    return number_within(hashed, [], hash_bucket(F.col("_h"), buckets_for(df.count())), ["_h", *ids], name).drop("_h")


def split(df: DataFrame, position: str = "position", train: float = 0.9, at_least_one: bool = False) -> DataFrame:
    """Adds ``split``: the first ``train`` share by shuffled position is train, the rest val."""
    n = df.agg(F.count(F.lit(1))).scalar()
    val = F.floor(F.lit(round(1 - train, 9)) * n)
    cut = n - F.greatest(F.lit(1), val) if at_least_one else F.floor(F.lit(train) * n)
    return df.withColumn("_cut", cut).withColumn(
        "split", F.when(F.col(position) < F.col("_cut"), "train").otherwise("val")
    ).drop("_cut")


# --- triplets ---------------------------------------------------------------------------------

def triplets(
    corpus: DataFrame, target: int, seed: int = 42, fk_positives: bool = True,
    views: list[str] | None = None,
) -> DataFrame:
    """(attempt, db, anchor, positive, negative_db, negative[, view]): the first ``target`` of
    3 x ``target`` attempts that found a positive.

    Anchor database and anchor table are uniform. The positive is one of the anchor's references
    (maybe itself) or, without any, another table of the database; the negative is any table of
    another database.
    """
    spark = corpus.sparkSession
    dbs, tables = index(corpus)
    n_dbs = dbs.agg(F.count(F.lit(1))).scalar()
    i = F.col("attempt")

    def db_as(ord_name: str, db_name: str, n_name: str) -> DataFrame:
        return dbs.select(
            F.col("db_ord").alias(ord_name), F.col("database_name").alias(db_name), F.col("n_tables").alias(n_name)
        )

    def table_as(db_name: str, ord_name: str, out: str) -> DataFrame:
        return tables.select(
            F.col("database_name").alias(db_name), F.col("tab_ord").alias(ord_name), F.col("table_name").alias(out)
        )

    def attempts(first: int, last: int) -> DataFrame:
        drawn = (
            spark.range(first, last).withColumnRenamed("id", "attempt")
            .withColumn("n_dbs", n_dbs)
            .withColumn("db_ord", pick(F.col("n_dbs"), seed, i, "db"))
            .withColumn("neg_db_ord", pick_other(F.col("n_dbs"), F.col("db_ord"), seed, i, "negative db"))
            .join(db_as("db_ord", "db", "n"), "db_ord")
            .join(db_as("neg_db_ord", "negative_db", "neg_n"), "neg_db_ord")
            .withColumn("tab_ord", pick(F.col("n"), seed, i, "table"))
            .withColumn("neg_ord", pick(F.col("neg_n"), seed, i, "negative"))
            .withColumn("other_ord", pick_other(F.col("n"), F.col("tab_ord"), seed, i, "other"))
            .join(table_as("db", "tab_ord", "anchor"), ["db", "tab_ord"])
        )
        if lists is not None:
            drawn = drawn.join(lists, ["db", "anchor"], "left").withColumn(
                "referenced", F.get("targets", pick(F.size("targets"), seed, i, "fk"))
            )
        else:
            drawn = drawn.withColumn("referenced", F.lit(None).cast("string"))
        return (
            drawn.join(table_as("db", "other_ord", "other"), ["db", "other_ord"], "left")
            .join(table_as("negative_db", "neg_ord", "negative"), ["negative_db", "neg_ord"])
            .withColumn("positive", F.coalesce("referenced", "other"))
            .filter(F.col("positive").isNotNull())
            .select(*out)
        )

    lists = fk_lists(corpus).select(
        F.col("database_name").alias("db"), F.col("table_name").alias("anchor"), "targets"
    ) if fk_positives else None
    out = [i, F.col("db"), F.col("anchor"), F.col("positive"), F.col("negative_db"), F.col("negative")]
    if views:
        out.append(F.get(F.array(*map(F.lit, views)), pick(len(views), seed, i, "view").cast("int")).alias("view"))
    # in rounds, as most attempts find a positive; later ones could only come after the target
    made, found, last, most = None, 0, 0, 3 * target
    while made is None or found < target and last < most:
        share = max(found, 1) / max(last, 1)
        first, last = last, min(most, last + math.ceil(1.05 * (target - found) / share) + 64)
        part = written(attempts(first, last), "attempts")
        found += part.count()
        made = part if made is None else made.unionByName(part)
    return first_by(made, "attempt", target)


def first_by(df: DataFrame, position: str, n: int, bucket_rows: int = 65536) -> DataFrame:
    """The first n rows by a unique integer position, however large n is.

    The n-th position is found among the positions of one bucket, so rows are not shuffled. Reads ``df`` three
    times: store it first.
    """
    place = F.floor(F.col(position) / bucket_rows)
    sizes = df.where(F.col(position).isNotNull()).groupBy(place.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    upto = sizes.withColumn("_upto", F.sum("_n").over(Window.orderBy("_bucket")))
    at = upto.where(F.col("_upto") >= n).orderBy("_bucket").limit(1).collect()
    if not at:
        return df.where(F.col(position).isNotNull())
    inside = df.where(place == at[0]._bucket).select(position).orderBy(position).limit(max(0, n - at[0]._upto + at[0]._n))
    last = inside.agg(F.max(position)).first()[0]
    return df.where(F.col(position) <= F.lit(last))


def with_texts(ids: DataFrame, texts: DataFrame, columns: dict[str, tuple[str, str, Column | None]]) -> DataFrame:
    """Attach texts last. ``columns``: output name -> (database column, table column, view or None)."""
    out = ids
    for name, (db, tab, view) in columns.items():
        side = texts.select(
            F.col("database_name").alias("_d"), F.col("table_name").alias("_t"),
            F.col("view").alias("_v"), F.col("text").alias(name),
        )
        wanted = view if view is not None else F.lit("full")
        left = out.withColumn("_w", wanted)
        out = left.join(
            side, (left[db] == side["_d"]) & (left[tab] == side["_t"]) & (left["_w"] == side["_v"])
        ).drop("_d", "_t", "_v", "_w")
    return out


def triplet_texts(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """anchor_text, positive_text and negative_text beside the ids; the anchor in its drawn view."""
    views = ["full", "schema"] if "view" in ids.columns else ["full"]
    texts = fan_out(nonempty(corpus), views)
    return with_texts(ids, texts, {
        "anchor_text": ("db", "anchor", F.col("view") if "view" in ids.columns else None),
        "positive_text": ("db", "positive", None),
        "negative_text": ("negative_db", "negative", None),
    })


def smart_batches(triplet_rows: DataFrame, batch_size: int = 16, prefix: int = 60) -> DataFrame:
    """Triplets ordered by the start of the anchor text, cut into batches of neighbours."""
    keyed = triplet_rows.withColumn("_p", F.left("anchor_text", F.lit(prefix)))
    return (
        number_sorted(keyed, [F.col("_p"), F.col("attempt")], "position")
        .withColumn("batch", F.floor(F.col("position") / batch_size))
        .drop("_p")
    )


# --- texts ------------------------------------------------------------------------------------

def self_pairs(corpus: DataFrame, view: str = "full") -> DataFrame:
    text = serialize(view)
    return nonempty(corpus).select("database_name", "table_name", text.alias("text_a"), text.alias("text_b"))


def plain_texts(corpus: DataFrame, view: str = "full") -> DataFrame:
    return nonempty(corpus).select("database_name", "table_name", serialize(view).alias("text"))


def _div(a: Column, n: int) -> Column:
    return F.call_function("div", a, F.lit(n))


def mask_tokens(
    texts: DataFrame, text: str = "text", ids: tuple[str, ...] = ("database_name", "table_name"),
    window: int = 512, percent: int = 15, seed: int = 42, mask: str = "[MASK]",
) -> DataFrame:
    """Masked token windows of whole texts: (ids, window, tokens, labels).

    ``percent`` of the tokens are chosen; of these 80 % become the mask, 10 % another token of the
    same text, 10 % stay. ``labels`` holds the chosen tokens, null elsewhere. The first window is
    what a tokenizer truncating at ``window`` keeps; the others are the rest of the text.
    """
    key = [F.col(c) for c in ids]

    def masked(t: Column, i: Column) -> Column:
        # one hash per token, bound by a one-element transform, serves all three draws
        def draw(r: Column) -> Column:
            chosen, kind = r % 100 < percent, _div(r, 100) % 10
            swap = F.get("_toks", (_div(r, 1000) % F.size("_toks")).cast("int"))
            new = F.when(chosen & (kind < 8), F.lit(mask)).when(chosen & (kind == 8), swap).otherwise(t)
            return F.struct(new.alias("token"), F.when(chosen, t).alias("label"))

        return F.transform(F.array(h(seed, *key, i)), draw)[0]

    toks = F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "")
    whole = (
        texts.filter(F.col(text).rlike(r"\S")).withColumn("_toks", toks)
        .select(*ids, F.transform("_toks", masked).alias("_m"))
    )
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_m") - 1) / window)),
        lambda w: F.slice(F.col("_m"), (w * window + 1).cast("int"), F.lit(window)),
    )
    return whole.select(*ids, F.posexplode(cut).alias("window", "_w")).select(
        *ids, "window",
        F.transform("_w", lambda x: x["token"]).alias("tokens"),
        F.transform("_w", lambda x: x["label"]).alias("labels"),
    )


def sample(df: DataFrame, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, as many as exist if fewer; any n."""
    return shuffled(df, ids, seed, "_place").filter(F.col("_place") < n).drop("_place")


def sample_per_group(df: DataFrame, keys: list[str], ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows of each group without replacement; the limit is applied before the shuffle."""
    drawn = df.withColumn("_h", h(seed, *[F.col(c) for c in keys + ids]))
    w = Window.partitionBy(*keys).orderBy("_h", *ids)
    return drawn.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= n).drop("_h")
