"""Joins by stem, splits, shards, numbering, limits and set operations."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import fresh, with_position


def join_all(stem: str, first: DataFrame, *rest: DataFrame, how: str = "inner") -> DataFrame:
    """Joins of parallel artifact tables by stem: Catalyst and AQE choose how."""
    for other in rest:
        first = first.join(other, stem, how)
    return first


def left_or_empty(stem: str, first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Left joins where a missing string is the empty string."""
    out = join_all(stem, first, *rest, how="left")
    added = {c for other in rest for c in other.columns} - {stem}
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in added})


def having(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def lacking(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a ledger or output doesn't have yet."""
    return df.join(done.select(key), key, "left_anti")


def of_split(df: DataFrame, test: DataFrame, split: str, key: str = "stem") -> DataFrame:
    """The rows of a split, where ``test`` lists the held-out stems: train, test or all."""
    if split not in ("train", "test", "all"):
        raise ValueError(f"split: {split}")
    return df if split == "all" else (having if split == "test" else lacking)(df, test, key)


def all_keys(key: str, *tables: DataFrame) -> DataFrame:
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.union(t.select(key))
    return out.distinct()


def shard(df: DataFrame, shards: int, index: int, *order: str) -> DataFrame:
    """Every shards-th row in order, from index."""
    if shards < 1 or not 0 <= index < shards:
        raise ValueError(f"shard {index} of {shards}")
    at = fresh(df, "position")
    return with_position(df, *order, name=at).where(F.col(at) % shards == index).drop(at)


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    at = fresh(df, "position")
    return with_position(df, *order, name=at).withColumn("batch", F.floor(F.col(at) / size)).drop(at)


def numbered(df: DataFrame, prefix: str, *order: str, start: int = 1) -> DataFrame:
    """new_stem prefix-n in order."""
    at = fresh(df, "position")
    return with_position(df, *order, name=at).withColumn("new_stem", F.concat(F.lit(f"{prefix}-"), F.col(at) + start)).drop(at)


def free_numbers(unnamed: DataFrame, used: DataFrame, order: str, number: str = "n", start: int = 1) -> DataFrame:
    """Each unnamed row with the next number from start on that isn't used: the k-th row gets the k-th gap."""
    count = unnamed.count()
    high = used.agg(F.max(number)).first()[0] or 0
    numbers = unnamed.sparkSession.range(start, max(high, start) + count + 1).toDF(number)
    at = fresh(unnamed, "position")
    gaps = with_position(numbers.join(used.select(number), number, "left_anti"), number, name=at)
    return with_position(unnamed, order, name=at).join(gaps, at).drop(at)


def first_k(df: DataFrame, k: int, group: list[str], *order: str) -> DataFrame:
    """The first k of each group; Spark keeps k of each before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    n = fresh(df, "_n")
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) <= k).drop(n)


def limited(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def regroup(samples: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """The samples of each key, in order of their index."""
    pairs = F.array_sort(F.collect_list(F.struct(index, value)))
    return samples.groupBy(key).agg(F.transform(pairs, lambda x: x[value]).alias("samples"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by the columns over all tasks, for costly work on each: a small file, or one with a single row group, is read by one task, and a joined table may be in few."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def repeated(df: DataFrame, n: int, index: str = "sample_idx") -> DataFrame:
    return df.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def seeded_order(seed: int, key: Column | str) -> Column:
    """A shuffle's order that hangs on seed and key alone; not the permutation of any other library."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def split_by_hash(df: DataFrame, key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """A column ``split``: the first int(n * share) rows in seeded order are train, the rest test."""
    n = df.count()
    at = fresh(df, "position")
    ranked = with_position(df, seeded_order(seed, key), key, name=at)
    return ranked.withColumn("split", F.when(F.col(at) < int(n * share), "train").otherwise("test")).drop(at)


#: Rows whose places the driver may hold to repeat another library's shuffle.
MOST_SHUFFLED = 5_000_000


def split_by_shuffle(df: DataFrame, order: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """The split of random.Random(seed).shuffle over rows in order: for lists that fit the driver (numbers only, 8 bytes each)."""
    n = df.count()
    if n > MOST_SHUFFLED:
        raise ValueError(f"{n} rows: split_by_shuffle holds their places on the driver and takes {MOST_SHUFFLED} at most; use split_by_hash")
    places = list(range(n))
    random.Random(seed).shuffle(places)
    at, taken = fresh(df, "position"), fresh(df, "_in")
    train = df.sparkSession.createDataFrame([(p,) for p in places[: int(n * share)]], f"`{at}` long")
    ranked = with_position(df, order, name=at)
    return ranked.join(train.withColumn(taken, F.lit(True)), at, "left").withColumn("split", F.when(F.col(taken), "train").otherwise("test")).drop(taken, at)


def union_sheets(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables in one, their names in a first column; columns that a table lacks are null."""
    out = None
    for name, t in tables.items():
        t = t.select(F.lit(name).alias("__sheet__"), "*")
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def drop_empty(df: DataFrame) -> DataFrame:
    """Without rows, then columns, that are all null; one pass of counts."""
    df = df.na.drop("all")
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for k, c in enumerate(df.columns) if counts[str(k)]])
