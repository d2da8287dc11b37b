"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source of n rows and weight w gets the mean repetition rate budget * w / n (weights sum to 1). Each row's count is
the Poisson quantile of a uniform number made from an md5 of seed and name: the same for the same row wherever and
however often it is computed. A row's name is its id; rows without an id, or that share one, are named by an md5 of their
columns' text form, too, and numbered where that is the same. The name only decides how often a row is drawn: no row
stands for another, whatever their text forms have in common. Rows are exploded by their counts and
dealt to partitions, and sorted in them, by an md5 of seed, name and replica: a shuffle over all sources without a
driver's or a task's view of the whole.

The rates' table has a row a source. Its rows are counted first: up to MOST_BROADCAST they are broadcast, so that texts
move once, in the shuffle, and a source that holds a third of all rows is nowhere together. Ids that are shared are
found by counting ids alone; only rows with such an id (by a filter of fixed size) move once more. They are numbered within
the partitions they were read in, after as many as earlier partitions hold, so that no group of equal rows meets in a task.

Defined results: a null source is a source; null and repeated ids draw as said above, equal rows each; a source without
a weight, or of weight 0, is left out; null and empty texts count as rows; other columns are kept, whatever their names:
where one has the name of an added column (replica, shuffle_key), in either case, the added one gets underscores at its
end; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, let, with_maybe, written

SEED = 20_240
#: Quantiles are found by adding up probabilities; rates above this are split over so many draws.
MOST_RATE = 20.0
#: The rates are broadcast if there are so many sources at most; if more, the join is a shuffle.
MOST_BROADCAST = 20_000
#: Text forms of rows show microseconds.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def uniform(*of: Column) -> Column:
    """In [0, 1), from 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *of)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson(rate: Column, u: Column) -> Column:
    """The least k with P(X <= k) > u, for rates up to MOST_RATE."""
    last = 120  # the tail beyond is below 2^-52 at MOST_RATE
    step = lambda s, k: F.when(s["c"] > u, s).otherwise(F.struct((s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"), k.alias("k")))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(last)), start, step, lambda s: s["k"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, budget: float | None = None, source_col: str = "source") -> DataFrame:
    """(__mix_source, __mix_rate). weights: of each source; without them a source's weight is its number of rows to
    the given power. budget: rows wanted (in the mean); as many as there are, if none is given."""
    sizes = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("__mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        w = F.lit(0.0)
        for k, v in weights.items():
            w = F.when(F.col("__mix_source") == k, F.lit(float(v))).otherwise(w)
    sizes = sizes.withColumn("w", w)
    total = sizes.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("sources")).first()
    wanted = float(budget if budget is not None else total["n"] or 0)
    scale = wanted / total["w"] if total["w"] else 0.0
    rates = sizes.select("__mix_source", (F.col("w") * F.lit(scale) / F.col("n")).alias("__mix_rate"))
    return F.broadcast(rates) if total["sources"] <= MOST_BROADCAST else rates


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (written, with __mix_row, their monotonic ids) with __mix_k: their numbers among rows of equal keys. Groups are
    split by the partitions that rows were read in; what is summed over a group is a count a partition."""
    rows = rows.withColumn("__mix_part", F.shiftright("__mix_row", 33))
    counts = rows.groupBy(*keys, "__mix_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__mix_before", F.coalesce(before, F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(*keys, "__mix_part").orderBy("__mix_row"))
    return rows.withColumn("__mix_k", place).join(counts, [*keys, "__mix_part"]).withColumn("__mix_k", F.col("__mix_before") + F.col("__mix_k"))


def named(docs: DataFrame) -> DataFrame:
    """docs (__mix_doc, __mix_id) with __mix_name, by which a row draws."""
    shared = docs.groupBy("__mix_id").agg(F.count("*").alias("n"))
    shared = written(shared.where("n > 1 or __mix_id is null").select(F.coalesce("__mix_id", F.lit("\0")).alias("__mix_id")))
    if shared.isEmpty():
        return docs.withColumn("__mix_name", F.col("__mix_id"))
    key = F.coalesce("__mix_id", F.lit("\0"))
    rows = with_maybe(docs, key, shared, "__mix_maybe")
    plain = rows.where(~F.col("__mix_maybe")).select(*docs.columns, F.col("__mix_id").alias("__mix_name"))
    hard = rows.where("__mix_maybe").withColumns({"__mix_id": key, "__mix_hash": F.md5(F.to_json("__mix_doc", JSON)), "__mix_row": F.monotonically_increasing_id()})
    hard = numbered(written(hard), "__mix_id", "__mix_hash").join(shared.withColumn("__mix_shared", F.lit(True)), "__mix_id", "left")
    name = F.when(F.col("__mix_shared"), F.concat_ws(":", "__mix_id", "__mix_hash", "__mix_k")).otherwise(F.col("__mix_id"))
    return plain.unionByName(hard.select(*docs.columns, name.alias("__mix_name")))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, budget: float | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", replica_col: str | None = "replica", key_col: str | None = "shuffle_key") -> DataFrame:
    """docs' rows, each as often as drawn, globally shuffled; with the replica's number and the shuffle's key."""
    rates = source_rates(docs, weights, power, budget, source_col)
    # a row's columns go on as one, so that their names clash with none of these
    rows = docs.select(F.struct("*").alias("__mix_doc"), F.col(id_col).cast("string").alias("__mix_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("__mix_source"))
    rows = named(rows).join(rates, "__mix_source").where("__mix_rate > 0")
    name = F.col("__mix_name")
    parts = F.greatest(F.ceil(F.col("__mix_rate") / MOST_RATE), F.lit(1))
    draw = lambda k: poisson(F.col("__mix_rate") / parts, uniform(F.lit(str(seed)), k.cast("string"), name))
    count = F.aggregate(F.transform(F.sequence(F.lit(1).cast("long"), parts), draw), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("__mix_replica", F.explode(let(count, lambda n: F.when(n > 0, F.sequence(F.lit(1), n)))))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.lit("order"), F.col("__mix_replica"), name)), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("__mix_key", key).repartition("__mix_key").sortWithinPartitions("__mix_key")
    taken = [*docs.columns]
    more = []
    for column, wanted in (("__mix_replica", replica_col), ("__mix_key", key_col)):
        if wanted:
            taken.append(free_name(wanted, taken))
            more.append(F.col(column).alias(taken[-1]))
    return rows.select("__mix_doc.*", *more)
