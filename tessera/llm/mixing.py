"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

A source's target over its size is how often each of its rows is due: a whole number of times, and once more
with a probability. Those probabilities are rounded in pairs: of two rows, the mass (probability times size)
moves from one to the other, in a random direction that keeps both expectations, until one of them is 0 or 1;
the other meets the next row. Each group of about ``fan_in`` rows is folded so and leaves one fractional row;
these are folded again, level by level, until a source has one left, which a coin decides. So a source's words
are its target but for a share of that last row. Groups are dealt by hash and are alike in size however large
a source is.

Cases: null texts have size 0 and take nothing; null is a source of its own, the last one; rows that are the
same in all key columns are rounded as separate rows; an empty table gives an empty result. Coins are hashes
of the rows' keys and a seed: reruns agree, whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, fresh, stage

#: The weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """From (source, source_size): the target of each, at most ``most`` times its size, the excess reshared by weight.

    One row a source; their number, not that of documents, bounds the single task that orders them.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    s = s.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("nth", F.row_number().over(order))
    held = F.min(F.when(F.col("full_at") >= F.col("level") * (1 - 1e-12), F.struct("nth", "level"))).over(everything)["level"]
    return s.select("source", "source_size", F.least("cap", F.coalesce(held, F.lit(0.0)) * F.col("weight")).alias("target"))


def _coin(*of: Column) -> Column:
    """A uniform number in [0, 1) from the hash of what it is given."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(rows: Column, seed: Column, empty: Column) -> Column:
    """Folds an array of struct(size, h, key, p): struct(done: those decided, rest: the one left)."""

    def step(acc: Column, b: Column) -> Column:
        a = acc["rest"]
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])

        def moved(m: Column) -> Column:
            rise = _coin(seed, a["h"], b["h"]) * (m["up"] + m["down"]) < m["down"]
            by = F.when(rise, m["up"]).otherwise(-m["down"])
            # Exact ends: whoever's own limit was the smaller lands on 0 or 1 without rounding errors.
            a_ends = F.when(rise, (1 - a["p"]) * a["size"] <= b["p"] * b["size"]).otherwise(a["p"] * a["size"] <= (1 - b["p"]) * b["size"])
            end = F.when(a_ends == rise, F.lit(1.0)).otherwise(F.lit(0.0))
            return F.struct(by.alias("by"), a_ends.alias("a_ends"), end.alias("end"))

        def put(m: Column) -> Column:
            over, under = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)), F.struct
            done = F.when(m["a_ends"], under(a["size"].alias("size"), a["h"].alias("h"), a["key"].alias("key"), m["end"].alias("p"))).otherwise(under(b["size"].alias("size"), b["h"].alias("h"), b["key"].alias("key"), m["end"].alias("p")))
            rest = F.when(m["a_ends"], under(b["size"].alias("size"), b["h"].alias("h"), b["key"].alias("key"), over(b["p"] - m["by"] / b["size"]).alias("p"))).otherwise(under(a["size"].alias("size"), a["h"].alias("h"), a["key"].alias("key"), over(a["p"] + m["by"] / a["size"]).alias("p")))
            return F.struct(F.concat(acc["done"], F.array(done)).alias("done"), rest.alias("rest"))

        return _let(_let(F.struct(up.alias("up"), down.alias("down")), moved), put)

    return F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), F.struct(empty.alias("done"), F.element_at(rows, 1).alias("rest")), step)


def mix(docs: DataFrame, key: tuple[str, ...] = ("doc_id",), source: str = "source", size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 17, fan_in: int = 256) -> DataFrame:
    """How often the mix takes each row: the key columns, source, size, source_size, target, copies, and nth of rows with equal keys."""
    size = word_count(F.col("text")) if size is None else size
    rows = docs.select(*key, F.col(source).alias("source"), size.alias("size")).groupBy(*key, "source", "size").agg(F.count("*").alias("equal"))
    rows = stage(rows, "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("source_size"), F.sum("equal").alias("source_rows"))
    targets = stage(source_targets(totals.select("source", "source_size"), weights, most).join(totals.select(F.col("source").alias("s"), "source_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    of = targets.select(F.col("source").alias("s"), "source_size", "target", "source_rows")
    largest = targets.agg(F.max("source_rows")).first()[0] or 0
    rows = rows.join(of, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("equal")))).drop("equal")
    due = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("due", due).withColumn("h", F.xxhash64(*key, "source", "nth"))
    part = F.col("due") - F.floor("due")
    open_ = (F.col("size") > 0) & (part > 0)
    keyed = F.struct(*key, "size", "nth")
    todo = rows.where(open_).select("source", "source_rows", F.struct(F.col("size").cast("double").alias("size"), "h", keyed.alias("key"), part.alias("p")).alias("row"))
    decided, level = None, 0
    kind = todo.schema["row"].dataType.simpleString()
    n = largest
    while True:
        groups = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / fan_in)).cast("long")
        folded = (
            todo.groupBy("source", groups.alias("groups"), F.pmod(F.xxhash64(F.lit(seed + level), "row.h"), groups).alias("g"))
            .agg(F.sort_array(F.collect_list("row"), asc=False).alias("rows"))
            .select("source", F.col("groups").alias("source_rows"), _fold(F.col("rows"), F.lit(seed + level), F.expr(f"cast(array() as array<{kind}>)")).alias("f"))
        )
        folded = stage(folded, "mix-fold")
        done = folded.select("source", F.explode("f.done").alias("row"))
        decided = done if decided is None else decided.unionByName(done)
        todo = folded.select("source", "source_rows", F.col("f.rest").alias("row"))
        n, level = math.ceil(n / fan_in), level + 1
        if n <= 1:
            break
    last = todo.select("source", F.struct("row.size", "row.h", "row.key", F.when(_coin(F.lit(seed + level), F.col("row.h")) < F.col("row.p"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("p")).alias("row"))
    extra = decided.unionByName(last).select("source", "row.key.*", F.col("row.p").cast("int").alias("extra"))
    fixed = rows.where(~open_).select("source", *key, "size", "nth", F.lit(0).alias("extra"))
    s = F.col("source").eqNullSafe(F.col("s"))
    out = extra.unionByName(fixed).join(of, s).drop("s", "source_rows").withColumn("copies", F.floor(due).cast("int") + F.col("extra"))
    return out.select(*key, "source", "size", "nth", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix themselves, each as often as it is taken, with the columns of docs (doc_id, text and source among them)."""
    key, nth = fresh(docs, "mix_key"), fresh(docs, "mix_nth")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text", "source"))
    taken = mix(keyed, key=(key,), **options)
    other, each = fresh(keyed, "mix_other"), fresh(keyed, "mix_each")
    copies = stage(taken.groupBy(F.col(key).alias(other)).agg(F.sort_array(F.collect_list(F.struct("nth", "copies"))).alias(each)), "mix-copies")
    # Rows of one key are counted off; that needs no shuffle beyond the join's.
    joined = keyed.join(copies.where(F.exists(each, lambda x: x["copies"] > 0)), F.col(key) == F.col(other))
    joined = joined.withColumn(nth, F.row_number().over(Window.partitionBy(other).orderBy(other)))
    times = F.coalesce(F.get(each, F.col(nth) - 1)["copies"], F.lit(0))
    return joined.where(times > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
