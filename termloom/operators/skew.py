"""Per-key figures where a few keys own most rows.

Counts and sums are mergeable, so every task first folds its own rows: a key reaches the shuffle at most once a bucket
from each map task, however many rows it has. Exact quantiles come from value histograms, refined until the wanted rank
falls into a bucket one value wide; the values of a hot key are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import stored

#: A bucket of the first histogram spans values alike in sign, bit length and leading BITS bits; each round then cuts an open
#: one into 1 << BITS.
BITS = 6
#: A key with at least this share of the rows is hot; by counting, at most so many keys are.
HOT_SHARE = 200


def _shift(v: Column, bits: Column) -> Column:
    return F.call_function("shiftright", v, bits.cast("int"))


def _first_bucket(v: Column) -> Column:
    """Number of v's bucket, in order of the values: values below 1 << BITS have one each, above, 1 << (BITS - 1) buckets
    share a bit length; negative values mirror them. A whole 64-bit range has fewer than 4,000."""
    size = F.when(v < 0, F.bitwise_not(v)).otherwise(v)
    drop = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    number = F.when(size < 1 << BITS, size).otherwise(drop * (1 << (BITS - 1)) + _shift(size, drop))
    return F.when(v < 0, -1 - number).otherwise(number)


def _width(bucket: Column) -> Column:
    """How many low bits the values of a first bucket may differ in."""
    number = F.when(bucket < 0, -1 - bucket).otherwise(bucket)
    return F.greatest(_shift(number, F.lit(BITS - 1)) - 1, F.lit(0)).cast("int")


def _holding(histogram: Column, wanted: Column, base: Column) -> Column:
    """(upto, base, bucket): the bucket of a sorted (bucket, c) array that holds rank wanted, base ranks lying before it."""
    start = F.struct(base.alias("upto"), base.alias("base"), F.lit(None).cast("bigint").alias("bucket"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct((acc["upto"] + x["c"]).alias("upto"), acc["upto"].alias("base"), x["bucket"].alias("bucket"))
        return F.when(acc["upto"] < wanted, taken).otherwise(acc)

    return F.aggregate(histogram, start, step)


def _keyed(df: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, str]:
    """(k0, k1, ..., v) and the type that all keys fit: bigint if each is a whole number, else string."""
    whole = all(df.select(k).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint") for k in keys)
    kind = "bigint" if whole else "string"
    return df.select(*[F.col(k).cast(kind).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).cast("bigint").alias("v")), kind


def _histograms(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key: its totals and the array (bucket, c) of its values, from one reading of rows for all key columns."""
    names = [f"k{i}" for i in range(len(keys))]
    bucketed = rows.withColumn("bucket", _first_bucket(F.col("v")))
    folded = bucketed.groupingSets([[n, "bucket"] for n in names], *names, "bucket").agg(
        *[F.grouping(n).alias(f"no_{n}") for n in names], F.count(F.lit(1)).alias("c"), F.try_sum("v").alias("s"), F.count("v").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    column = reduce(lambda rest, i: F.when(F.col(f"no_k{i}") == 0, keys[i]).otherwise(rest), range(len(keys)), F.lit(None))
    one = reduce(lambda rest, i: F.when(F.col(f"no_k{i}") == 0, F.col(f"k{i}")).otherwise(rest), range(len(keys)), F.lit(None))
    named = folded.select(column.alias("key_column"), one.alias("key_value"), "bucket", "c", "s", "held", "lo", "hi").where("key_value IS NOT NULL")
    return named.groupBy("key_column", "key_value").agg(
        F.sum("c").alias("row_count"),
        F.when(F.count_if((F.col("held") > 0) & F.col("s").isNull()) == 0, F.try_sum("s")).alias("value_sum"),
        F.min("lo").alias("value_min"),
        F.max("hi").alias("value_max"),
        F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "c")))).alias("histogram"),
    )


def key_profiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """Figures of an integer column for every value of each key column.

    key_column, key_value, row_count, value_sum, value_min, value_max and a column p<percent> for each quantile q: the value
    of rank max(1, ceil(q n)) among the key's n values. key_value is a bigint if all key columns are whole numbers, else a
    string. Rows with a null key are left out (it names no key); null values count as rows only, and a key without
    values has null figures. An empty table gives no rows. Other columns do not matter. A sum beyond 64 bits is null.

    df is read once for all key columns: rows, sums and extremes are folded per key and bucket, on the map side first. A
    key's histogram has a bounded number of entries, so it sits in one row. Values below 1 << BITS are exact then. Where
    a wanted rank lies in a wider bucket, df is read once more and the rows of such buckets are kept: those of
    hot keys (at most HOT_SHARE a column by the definition of hot) by a broadcast of their buckets, all others by a
    shuffled join, where no key has more than 1 / HOT_SHARE of the rows. Further rounds read the kept rows only, at most 10 for 64 bits.
    """
    qs = sorted({float(q) for q in quantiles})
    if not qs or qs[0] < 0 or qs[-1] > 1:
        raise ValueError("quantiles must lie in [0, 1]")
    rows, kind = _keyed(df, keys, value)
    n_values = F.aggregate("histogram", F.lit(0).cast("bigint"), lambda a, x: a + x["c"])
    names = [f"p{round(q * 100)}" for q in qs]
    totals = ["key_column", "key_value", "row_count", "value_sum", "value_min", "value_max"]

    def ranked(q: float) -> Column:
        wanted = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(q) * n_values))
        return F.struct(wanted.alias("wanted"), _holding(F.col("histogram"), wanted, F.lit(0).cast("bigint")).alias("at"))

    found = stored(_histograms(rows, keys).select(*totals, *[ranked(q).alias(f"r{i}") for i, q in enumerate(qs)]))
    widest = found.agg(F.max(F.greatest(F.lit(0), *[F.coalesce(_width(F.col(f"r{i}.at.bucket")), F.lit(0)) for i in range(len(qs))])).alias("w")).first()["w"]
    if not widest:
        return found.select(*totals, *[F.col(f"r{i}.at.bucket").alias(n) for i, n in enumerate(names)])

    exact = [F.when(_width(F.col(f"r{i}.at.bucket")) == 0, F.col(f"r{i}.at.bucket")).alias(f"e{i}") for i in range(len(qs))]
    each = F.array(*[F.struct(F.lit(i).alias("q"), F.col(f"r{i}.wanted").alias("wanted"), F.col(f"r{i}.at.base").alias("base"), F.col(f"r{i}.at.bucket").alias("bucket")) for i in range(len(qs))])
    open_ = found.select("key_column", "key_value", "row_count", F.explode(each).alias("x")).select("key_column", "key_value", "row_count", "x.*").where(_width(F.col("bucket")) > 0)
    by = ["key_column", "key_value", "hot", "q", "wanted", "base"]
    is_hot = F.col("row_count") * HOT_SHARE >= df.count()
    kept = stored(_rows_of(rows, keys, open_.withColumn("width", _width(F.col("bucket"))).withColumn("hot", is_hot).drop("row_count")))
    done: list[DataFrame] = []
    while widest:
        finer = F.greatest(F.col("width") - BITS, F.lit(0))
        counted = kept.withColumn("finer", _shift(F.col("v"), finer)).groupBy(*by, "width", "finer").agg(F.count(F.lit(1)).alias("c"))
        entries = F.array_sort(F.collect_list(F.struct(F.col("finer").alias("bucket"), "c")))
        held = counted.groupBy(*by, "width").agg(entries.alias("histogram")).withColumn("at", _holding(F.col("histogram"), F.col("wanted"), F.col("base")))
        at = stored(held.select(*by, finer.alias("finer"), F.col("at.base").alias("inner"), F.col("at.bucket").alias("bucket")))
        done.append(at.where("finer = 0").select("key_column", "key_value", "q", "bucket"))
        widest = max(0, widest - BITS)
        if widest:
            cut = at.where("finer > 0").select("key_column", "key_value", "hot", "q", F.col("inner").alias("base_in"), F.col("finer").alias("finer_in"), F.col("bucket").alias("bucket_in"))
            inside = _split_join(kept.where(F.col("width") > BITS), cut, ["key_column", "key_value", "q"]).where(_shift(F.col("v"), F.col("finer_in")) == F.col("bucket_in"))
            kept = stored(inside.select("key_column", "key_value", "hot", "q", "wanted", F.col("base_in").alias("base"), F.col("finer_in").alias("width"), "v"))
    values = reduce(DataFrame.unionByName, done)
    wide = values.groupBy("key_column", "key_value").agg(*[F.max(F.when(F.col("q") == i, F.col("bucket"))).alias(f"w{i}") for i in range(len(qs))])
    joined = found.select(*totals, *exact).join(wide, ["key_column", "key_value"], "left")
    return joined.select(*totals, *[F.coalesce(f"e{i}", f"w{i}").alias(n) for i, n in enumerate(names)])


def _split_join(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """rows joined to side on keys: hot keys by broadcast, no more than HOT_SHARE a key column and quantile, others shuffled."""
    own = rows.drop("hot")
    return own.join(F.broadcast(side.where("hot")), on).unionByName(own.join(side.where("NOT hot"), on))


def _rows_of(rows: DataFrame, keys: Sequence[str], open_: DataFrame) -> DataFrame:
    """key_column, key_value, hot, q, wanted, base, width, v of the rows that lie in an open bucket of their key."""
    parts = []
    for i, k in enumerate(keys):
        own = rows.select(F.lit(k).alias("key_column"), F.col(f"k{i}").alias("key_value"), "v", _first_bucket(F.col("v")).alias("bucket"))
        parts.append(_split_join(own.where("v IS NOT NULL AND key_value IS NOT NULL"), open_.where(F.col("key_column") == k).drop("key_column"), ["key_value", "bucket"]))
    return reduce(DataFrame.unionByName, parts).select("key_column", "key_value", "hot", "q", "wanted", "base", "width", "v")


def key_profile(df: DataFrame, key: str, value: str, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """key_profiles of one key column, without the column's name."""
    return key_profiles(df, [key], value, quantiles).drop("key_column")


def hot_keys(df: DataFrame, keys: Sequence[str], value: str, share: int = HOT_SHARE, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """The rows of key_profiles for keys that hold at least 1 / share of all rows of df, null keys included in the total."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows")).scalar()
    return key_profiles(df, keys, value, quantiles).where(F.col("row_count") * share >= total)
