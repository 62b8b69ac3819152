"""Reducers, accumulators, top-k and iterative reduction over keyed entries.

Every operator takes a declared order column (``seq``): insertion order decides
first, last and ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.numbers import col, to_double, to_double_or_zero


def reducer(op: str, value: Column | str, seq: Column | str = "seq") -> Column:
    """One aggregate by name; unknown names count, as ``count`` does.

    Numeric ones skip what isn't a number and give 0 for nothing.
    """
    v, raw = to_double(value), col(value)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    table = {
        "sum": lambda: zero(F.sum(v)),
        "avg": lambda: zero(F.avg(v)),
        "average": lambda: zero(F.avg(v)),
        "max": lambda: zero(F.max(v)),
        "min": lambda: zero(F.min(v)),
        "median": lambda: zero(F.median(v)),
        "stddev": lambda: zero(F.stddev_pop(v)),
        "variance": lambda: zero(F.var_pop(v)),
        "count_numeric": lambda: F.count(v),
        "first": lambda: F.min_by(raw, col(seq)),
        "last": lambda: F.max_by(raw, col(seq)),
        "distinct": lambda: F.count_distinct(raw) + F.max(raw.isNull().cast("int")),
        "concat": lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(col(seq).alias("s"), F.coalesce(raw.cast("string"), F.lit("")).alias("v")))), lambda e: e["v"]), ", "),
    }
    return table.get(op, lambda: F.count(F.lit(1)))()


def reduce_groups(df: DataFrame, group: str, value: str, ops: list[str], seq: str = "seq", only: str | None = None) -> DataFrame:
    """One row a group (null is "default"), one column an operation; ``only`` keeps one group, before the aggregate."""
    keyed = df.withColumn("group_key", F.coalesce(F.col(group).cast("string"), F.lit("default")))
    if only is not None:
        keyed = keyed.filter(F.col("group_key") == only)
    return keyed.groupBy("group_key").agg(*[reducer(o, value, seq).alias(f"{o}_value") for o in ops])


def accumulate(df: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """df with group_key, and how many entries its group and all groups had with each entry.

    The total is a running count of the whole table. It is taken by partitions
    of a sorted copy plus the sums of those before, so no single task holds all.
    """
    keyed = df.withColumn("group_key", F.coalesce(F.col(group).cast("string"), F.lit("default")))
    keyed = keyed.withColumn("group_count", F.count(F.lit(1)).over(Window.partitionBy("group_key").orderBy(seq)))
    return with_running_total(keyed, seq, F.lit(1), "total_count")


def with_running_total(df: DataFrame, seq: str, what: Column, name: str) -> DataFrame:
    """df with the sum of ``what`` up to each row in order of seq, two-staged: within blocks of rows, then over the blocks' sums.

    Blocks are ranges of the numeric order column; their number is bounded, so
    the window over them is small whatever the table's size.
    """
    ends = df.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi"))
    blocks = 4096
    block = F.least(F.floor((F.col(seq) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo") + 1, F.lit(1)) * blocks), F.lit(blocks - 1))
    placed = df.crossJoin(F.broadcast(ends.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi")))).withColumn("__block", block).withColumn("__what", what)
    sums = placed.groupBy("__block").agg(F.sum("__what").alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__block", "__before")
    inside = F.sum("__what").over(Window.partitionBy("__block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("__inside", inside).join(F.broadcast(before), "__block")
    return out.select(*df.columns, (F.col("__inside") + F.col("__before")).alias(name))


def top_k(df: DataFrame, k: int, score: str, seq: str = "seq", descending: bool = True, rank: str = "rank") -> DataFrame:
    """The k best rows (TakeOrderedAndProject); a missing score is 0, ties go by seq."""
    s = to_double_or_zero(score)
    order = [s.desc() if descending else s.asc(), F.col(seq).asc()]
    best = df.orderBy(*order).limit(k)
    # k rows at most: one task numbers them
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def top_k_by(df: DataFrame, group: list[str], k: int, score: str, seq: str = "seq", descending: bool = True, rank: str = "rank") -> DataFrame:
    """The k best rows of each group; Spark cuts groups before the shuffle (WindowGroupLimit)."""
    s = to_double_or_zero(score)
    w = Window.partitionBy(*group).orderBy(s.desc() if descending else s.asc(), F.col(seq).asc())
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def iterative_reduce(df: DataFrame, value: str, key: str, seq: str = "seq", op: str = "sum", batch: int = 10, target: int = 5, rounds: int = 10, cut: bool = True) -> DataFrame:
    """Batches of entries in order reduced again and again until ``target`` are left (or the rounds are over), then the best of those.

    An entry carries its reduced score, the key of the best entry in it and how
    many entries it stands for. The first numbering follows a range partitioned
    sort; each round is one aggregate, and their number is known from the count.
    Sums are taken in the entries' order, so equal batches tie. Without ``cut``
    all that the rounds leave stay.
    """
    n = df.count()
    numbered = with_running_total(df.select(F.col(seq).alias("seq"), to_double_or_zero(value).alias("score"), F.col(key).cast("string").alias("best_key")), "seq", F.lit(1), "i")
    cur = numbered.select((F.col("i") - 1).cast("long").alias("i"), "score", F.col("score").alias("best"), "best_key", F.lit(1).cast("long").alias("merged"))
    in_order = lambda c: F.aggregate(F.array_sort(F.collect_list(F.struct("i", c))), F.lit(0.0), lambda s, e: s + e[c])
    combine = {"sum": in_order, "avg": F.avg, "max": F.max, "min": F.min, "median": F.median}.get(op, in_order)
    done = 0
    while n > target and done < rounds:
        cur = cur.groupBy(F.floor(F.col("i") / batch).alias("i")).agg(
            combine("score").alias("score"),
            F.max("best").alias("best"),
            F.max_by("best_key", F.struct(F.col("best"), -F.col("i"))).alias("best_key"),
            F.sum("merged").alias("merged"),
        )
        n, done = -(-n // batch), done + 1
    return top_k(cur, target if cut else max(n, 1), "score", "i").select("rank", F.col("i").alias("batch_index"), "score", "best_key", "merged")


def round_count(n: int, batch: int = 10, target: int = 5, rounds: int = 10) -> int:
    done = 0
    while n > target and done < rounds:
        n, done = -(-n // batch), done + 1
    return done


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


# --- aggregation of signals: key, value_num, value_str, confidence, seq, tags -----------------


def highest_confidence(df: DataFrame, key: str = "key") -> DataFrame:
    """The most confident signal of each key; of equals the first."""
    return df.groupBy(key).agg(F.max_by(F.struct("value_num", "value_str", "confidence", "seq"), F.struct(F.col("confidence"), -F.col("seq"))).alias("s")).select(key, "s.*")


def most_recent(df: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct("value_num", "value_str", "confidence", "seq"), F.struct(F.col(ts), -F.col("seq"))).alias("s")).select(key, "s.*")


def weighted_average(df: DataFrame, key: str = "key") -> DataFrame:
    """(key, value, confidence): confidence-weighted mean of the numeric signals, 0 for zero weights; without any, the most confident one's."""
    v, c = F.col("value_num"), F.col("confidence")
    has = F.when(v.isNotNull(), c)
    total = F.sum(has)
    mean = F.when(total == 0, 0.0).otherwise(F.sum(v * c) / total)
    best = F.max_by(F.struct(v, c), F.struct(c, -F.col("seq")))
    out = df.groupBy(key).agg(F.when(F.count(v) > 0, mean).alias("value"), F.avg(has).alias("avg_c"), F.count(v).alias("n"), best.alias("best"))
    return out.select(key, "value", F.when(F.col("n") > 0, F.col("avg_c")).otherwise(F.col("best.confidence")).alias("confidence"))


def majority_vote(df: DataFrame, key: str = "key") -> DataFrame:
    """(key, value, confidence): the text value of the greatest summed confidence, and its share; ties go to the value seen first."""
    per = df.groupBy(key, "value_str").agg(F.sum("confidence").alias("weight"), F.min("seq").alias("first"))
    return per.groupBy(key).agg(F.max_by("value_str", F.struct(F.col("weight"), -F.col("first"))).alias("value"), (F.max("weight") / F.sum("weight")).alias("confidence"))


def collect_signals(df: DataFrame, key: str = "key") -> DataFrame:
    """(key, values in order, confidence)."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "value_num")))
    return df.groupBy(key).agg(F.transform(ordered, lambda e: e["value_num"]).alias("values"), F.avg("confidence").alias("confidence"))


def union_of_tags(df: DataFrame, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


def entity_row(df: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """One row an entity, one column a signal key: its most confident value."""
    best = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value_num")), F.when(F.col("key") == k, F.struct(F.col("confidence"), -F.col("seq")))).alias(k)
    return df.groupBy(entity).agg(*map(best, keys))
