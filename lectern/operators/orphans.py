"""References to records that do not exist, in time.

A reference names a parent row. It is sound if some parent row of that name had
arrived and was not deleted when the reference was made.

Plan. Both sides are first reduced to distinct pairs (name, month), so a hot name
that holds a third of all rows is a few dozen pairs before anything is shuffled.
Names fall into key ranges by hash. In each range they are encoded as dense integers;
per month there is one compressed bitmap of the names referred to and one of the
names with a parent alive over the whole month, and references AND-NOT parents are
decoded. Only the surviving (name, month) pairs are followed up exactly, by running
sums over arrivals and deletions, carried from slot to slot so that no name is ever
sorted in one task.

Defined results: a null or blank reference is no case; twins count once; a parent
without arrival time never existed in time, so references to it are 'late'; a
reference without a time is 'missing' if the name never occurs, else 'late'; with
an empty parent table every reference is 'missing'; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.bitmaps import Bitmap

#: White space of any kind at the ends of a name; the same pattern in Java and RE2.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NO_MONTH, NEVER_ENDS = -1, 1 << 30


def name_key(c: Column | str) -> Column:
    """Lower case without white space at both ends; inside, every character counts."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, f"^{BLANK}|{BLANK}$", ""))


def _month(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


def references(df: DataFrame, key: str, at: str, fields: tuple[str, ...], table: str) -> DataFrame:
    """One row per end: (table_name, key, ref_field, name, t); null and blank ends are left out."""
    ends = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), name_key(F.col(f)).alias("name")) for f in fields]))
    return (
        df.select(F.lit(table).alias("table_name"), F.col(key).alias("key"), F.col(at).alias("t"), ends.alias("e"))
        .select("table_name", "key", "e.ref_field", "e.name", "t")
        .filter(F.col("name") != "")
    )


def _surviving(asked: pa.StructArray, parents: pa.StructArray) -> pa.RecordBatch:
    """References AND-NOT parents of one key range: (name, month, known)."""
    of = lambda x, c: x.field(c).to_numpy(zero_copy_only=False)
    both = pa.concat_arrays([asked.field("name"), parents.field("name")]).dictionary_encode()
    code, month = both.indices.to_numpy(), of(asked, "month")
    r, p = code[: len(asked)], code[len(asked) :]
    ever, first, last = Bitmap.of(p), of(parents, "first_full"), of(parents, "last_full")
    order = np.argsort(month, kind="stable")
    months, starts = np.unique(month[order], return_index=True)
    ids, at, unknown = [], [], []
    for m, part in zip(months, np.split(order, starts[1:])):
        alive = Bitmap.of(p[(first <= m) & (m <= last)]) if m != NO_MONTH else Bitmap()
        left = Bitmap.of(r[part]).and_not(alive)
        ids.append(left.decode())
        at.append(np.full(len(ids[-1]), m, dtype=np.int32))
        unknown.append(np.isin(ids[-1], left.and_not(ever).decode()))
    ids = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_pydict(
        {
            "name": both.dictionary.take(pa.array(ids)),
            "month": pa.array(np.concatenate(at) if at else [], pa.int32()),
            "known": pa.array(~np.concatenate(unknown) if unknown else [], pa.bool_()),
        }
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        asked, parents = batch.column("asked"), batch.column("parents")
        for i in range(batch.num_rows):
            yield _surviving(*(x.slice(i, 1).flatten() for x in (asked, parents)))


def find_orphans(
    refs: DataFrame,
    parents: DataFrame,
    name: str = "name",
    arrived: str = "arrived_at",
    deleted: str = "deleted_at",
    ranges: int | None = None,
    salts: int = 8,
) -> DataFrame:
    """(table_name, key, ref_field, t, reason) for every end that refers to nothing.

    refs: as references() gives it. ranges: number of key ranges, by default four
    for each shuffle partition. salts: parts into which the references to one
    orphan name and month are split.
    """
    spark = refs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("name"), F.lit(ranges)).cast("int")
    month = F.coalesce(_month(F.col("t")), F.lit(NO_MONTH)).cast("int")
    refs = refs.withColumn("month", month)

    alive = parents.select(name_key(F.col(name)).alias("name"), F.col(arrived).alias("a"), F.col(deleted).alias("d")).filter(F.col("name") != "")
    whole = F.col("a") == F.date_trunc("month", "a")
    pairs = alive.select(
        "name",
        F.coalesce(_month(F.col("a")) + F.when(whole, 0).otherwise(1), F.lit(NEVER_ENDS)).cast("int").alias("first_full"),
        F.coalesce(_month(F.col("d")) - 1, F.lit(NEVER_ENDS)).cast("int").alias("last_full"),
    )
    # sets of distinct pairs are built before the shuffle as well as after it
    asked = refs.groupBy(part.alias("bucket")).agg(F.collect_set(F.struct("name", "month")).alias("asked"))
    pairs = pairs.groupBy(part.alias("bucket")).agg(F.collect_set(F.struct("name", "first_full", "last_full")).alias("parents"))
    left = asked.join(pairs, "bucket", "left").select("asked", "parents").mapInArrow(_ranges, "name string, month int, known boolean")

    salt = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")
    spread = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hit = refs.withColumn("salt", salt).join(spread, ["name", "month", "salt"]).drop("salt", "month")
    gone = hit.filter(~F.col("known")).select("table_name", "key", "ref_field", "t", F.lit("missing").alias("reason"))

    # exact check of the rest: parents alive and parents arrived at t
    known = left.filter("known").select("name").distinct()
    seen = alive.filter(F.col("a").isNotNull()).join(known, "name", "left_semi")
    lives = F.col("d").isNull() | (F.col("d") > F.col("a"))
    event = F.array(
        F.struct(F.col("a").alias("t"), F.when(lives, 1).otherwise(0).alias("alive"), F.lit(1).alias("arrived")),
        F.struct(F.col("d").alias("t"), F.when(lives, -1).otherwise(0).alias("alive"), F.lit(0).alias("arrived")),
    )
    events = (
        seen.select("name", F.explode(event).alias("e")).select("name", "e.*").filter(F.col("t").isNotNull())
        .groupBy("name", "t").agg(F.sum("alive").alias("alive"), F.sum("arrived").alias("arrived"))
    )
    open_refs = hit.filter("known").drop("known")
    slot = F.to_date("t").alias("slot")
    sums = [F.sum("alive").alias("alive"), F.sum("arrived").alias("arrived")]
    slots = (
        events.select("name", slot, "alive", "arrived")
        .unionByName(open_refs.select("name", slot, F.lit(0).alias("alive"), F.lit(0).alias("arrived")))
        .groupBy("name", "slot").agg(*sums)
    )
    before = W.partitionBy("name").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(None)
    blank = {"table_name": none.cast("string"), "key": none.cast(refs.schema["key"].dataType), "ref_field": none.cast("string")}
    carried = slots.select("name", "slot", none.cast("timestamp").alias("t"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("alive", "arrived")])
    line = (
        carried.withColumns(blank)
        .unionByName(events.select("name", slot, F.col("t").cast("timestamp").alias("t"), "alive", "arrived").withColumns(blank))
        .unionByName(open_refs.select("name", slot, F.col("t").cast("timestamp").alias("t"), F.lit(0).cast("long").alias("alive"), F.lit(0).cast("long").alias("arrived"), *blank))
    )
    upto = W.partitionBy("name", "slot").orderBy(F.col("t").asc_nulls_first()).rangeBetween(W.unboundedPreceding, W.currentRow)
    checked = (
        line.withColumns({"alive": F.sum("alive").over(upto), "arrived": F.sum("arrived").over(upto)})
        .filter(F.col("ref_field").isNotNull())
        .filter(F.col("t").isNull() | (F.col("alive") <= 0))
        .select("table_name", "key", "ref_field", "t", F.when(F.col("t").isNotNull() & (F.col("arrived") > 0), "deleted").otherwise("late").alias("reason"))
    )
    return gone.unionByName(checked.withColumn("t", F.col("t").cast(refs.schema["t"].dataType))).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per referring table, field, month and reason."""
    return orphans.groupBy("table_name", "ref_field", F.date_format("t", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n_orphans"))
