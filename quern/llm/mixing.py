"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import new_folder, saved, ship
from .sharded import Shards, Sorted, written_table
from .text import counts_of_words
from .text import mix as hashed

#: Documents that one flight handles; what it leaves undecided (at most two) flies again with that of other blocks.
BLOCK = 2048
#: Units of a source's last block, of sizes from large to small, kept for the landing: 2 ** (RESERVE + 2) choices at most.
RESERVE = 12
EPS = 1e-9


def flight(p: list[float], size: list[int], seed: int) -> list[float]:
    """Move probabilities p along directions that keep their sum and their sum weighted by size, until at most two are fractional.

    Of three open units with sizes a, b, c the direction is (b-c, c-a, a-b), the null space of both
    constraints. Units enter in the given order, so the last, smallest ones stay open.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    p, draws, at = list(p), rng.random(max(1, 2 * len(p))), 0
    open_: list[int] = []
    for i in range(len(p) + 1):
        while len(open_) >= 3 or i == len(p) and len(open_) == 2 and size[open_[0]] == size[open_[1]]:
            own = open_[:3]
            if len(own) == 3:
                a, b, c = (size[j] for j in own)
                v = [b - c, c - a, a - b]
                if v == [0, 0, 0]:
                    v = [1, -1, 0]
            else:
                v = [1, -1]
            ahead = min((1 - p[j]) / d if d > 0 else p[j] / -d for j, d in zip(own, v, strict=True) if d)
            back = min(p[j] / d if d > 0 else (1 - p[j]) / -d for j, d in zip(own, v, strict=True) if d)
            step = ahead if draws[at % len(draws)] * (ahead + back) < back else -back
            at += 1
            for j, d in zip(own, v, strict=True):
                p[j] = min(1.0, max(0.0, p[j] + step * d))
                if p[j] < EPS or p[j] > 1 - EPS:
                    p[j] = float(round(p[j]))
            open_ = [j for j in open_ if 0 < p[j] < 1]
        if i < len(p) and 0 < p[i] < 1:
            open_.append(i)
    return p


def landing(p: list[float], size: list[int]) -> list[float]:
    """Whole values for the last open units: those whose size total is nearest the expected one, then whose number is."""
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    own, chance = np.array([size[i] for i in open_], np.float64), np.array([p[i] for i in open_])
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(choices @ own - chance @ own)
    best = choices[np.lexsort((np.abs(choices.sum(1) - chance.sum()), np.round(off, 6)))[0]]
    p = list(p)
    for i, x in zip(open_, best, strict=True):
        p[i] = float(x)
    return p


def fly_and_land(p: list[float], size: list[int], seed: int) -> list[float]:
    """All units but a reserve of every size fly; what that leaves open and the reserve land together."""
    open_ = [i for i, x in enumerate(p) if 0 < x < 1 and size[i]]
    spare = [open_[(2 * k + 1) * len(open_) // (2 * RESERVE)] for k in range(RESERVE)] if len(open_) > RESERVE else open_
    held = set(spare)
    fly = [i for i in range(len(p)) if i not in held]
    out = list(p)
    for i, x in zip(fly, flight([p[i] for i in fly], [size[i] for i in fly], seed), strict=True):
        out[i] = x
    return landing(out, size)


def _fly(last: bool):
    def fly(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["row"].to_numpy(), table["u"].to_numpy(), -table["size"].to_numpy()))
        table = table.take(pa.array(order))
        size = table["size"].to_pylist()
        p = (fly_and_land if last else flight)(table["p"].to_pylist(), size, int(np.bitwise_xor.reduce(table["u"].to_numpy()) & 0x7FFFFFFF))
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64())).select(["row", "doc_id", "source", "size", "u", "p", *[c for c in table.column_names if c == "place"]])

    return fly


def _sizes(batches):
    for b in batches:
        more = [c for c in b.schema.names if c not in ("doc_id", "source", "text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(counts_of_words(b.column("text")), pa.int64()), *map(b.column, more)], ["doc_id", "source", "size", *more])


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n_docs, source_size, target: share * all words dealt by weight, no target above most * its source's size.

    Sources by code point, null last, take the weights in turn. The excess of a source at its bound is dealt
    again by weight: sorted by bound / weight, the level is the first that no later source exceeds. One row a
    source, so the windows without partitions hold the list of sources, not documents.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("k", F.row_number().over(every) - 1)
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    by = by.withColumn("bound", F.col("source_size") * F.lit(float(most)))
    w = Window.orderBy(F.col("bound") / F.col("w"), "k")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    by = by.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("w").over(w.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("bound"), F.col("k_order"))).over(whole)
    by = by.withColumn("k_order", F.row_number().over(w)).withColumn("first", level)
    by = by.withColumn("at", F.max(F.when(F.col("k_order") == F.col("first"), F.col("level"))).over(whole))
    return by.select("source", "n_docs", "source_size", F.least("bound", F.coalesce(F.col("at") * F.col("w"), F.col("bound"))).alias("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken and the columns `keep` (as kept_<name>) of every row: how often the mix takes it, and so how many words.

    A source whose target is r times its size takes every document floor(r) times and, by balanced sampling
    with probability r - floor(r), once more, so that both the words and the number of documents taken come
    out near their expectation. Null text has size 0; null sources are one source; repeated rows are separate
    units; empty input gives no rows; other columns are ignored. Reruns agree: all chance comes from hashes.

    A source's documents fly in blocks of bounded size, by a hash; what blocks leave open meets in the next
    round's blocks. So a hot source is many tasks, and a task never holds more than a few thousand numbers.
    """
    spark = documents.sparkSession
    ship(spark)
    kept = [f"kept_{c}" for c in keep]
    # Units fly without what is kept; it comes back by their place in the saved table, which tells equal rows apart too.
    place = ["place"] if keep else []
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"), *(F.monotonically_increasing_id().alias(c) for c in place), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)))
    shape = StructType.fromDDL("doc_id long, source string, size long")
    for c in (*place, *kept):
        shape.add(rows.schema[c])
    sizes = saved(rows.mapInArrow(_sizes, shape), "mix-sizes")
    goal = saved(targets(sizes, weights, share, most).withColumnRenamed("source", "of"), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.least(F.floor(ratio + EPS), F.lit(int(most)))
    # row tells repeated rows apart only as far as they differ; equal ones are interchangeable.
    row = F.xxhash64("doc_id", "size", "source", *kept)
    of = F.col("source").eqNullSafe(F.col("of"))
    units = sizes.join(goal, of).select(row.alias("row"), "doc_id", "source", "size", F.xxhash64(row, F.lit(7)).alias("u"), F.greatest(F.lit(0.0), ratio - copies).alias("p"), *place)
    schema = "row long, doc_id long, source string, size long, u long, p double" + ", place long" * len(place)
    undecided = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    parts, left = [units.where(~undecided)], units.where(undecided)
    n = goal.agg(F.max("n_docs")).first()[0] or 0
    while n:
        blocks = -(-n // block)
        spread = left.withColumn("b", F.pmod(F.xxhash64("u", F.lit(blocks)), F.lit(blocks)))
        flown = saved(spread.groupBy("source", "b").applyInArrow(_fly(blocks == 1), schema), "mix-flight")
        parts.append(flown.where(~undecided))
        left = flown.where(undecided)
        n = 0 if blocks == 1 else max(1, 2 * blocks)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    taken = (copies + F.round("p").cast("long")).cast("long")
    out = every.join(goal, of).select("doc_id", "size", "source_size", "target", taken.alias("copies"), (taken * F.col("size")).alias("taken"), "source", *place)
    if not keep:
        return out
    # What is kept stays where it is: a scan looks up each row's copies, and no text is shuffled.
    folder = new_folder(spark, "mix-taken")
    shards = written_table(out, folder, "taken", "place", ("source_size", "target", "copies"))
    schema = "doc_id long, size long, source_size long, target double, copies long, taken long, source string"
    return sizes.mapInArrow(_with_copies(folder, shards, kept), StructType([*StructType.fromDDL(schema), *(sizes.schema[k] for k in kept)]))


def _with_copies(folder: str, shards: Shards, kept: list[str]):
    def look(batches):
        known = Sorted(folder, "taken", shards, ("source_size", "target", "copies"))
        for b in batches:
            whole, target, copies = known.get(hashed(b.column("place").to_numpy().view(np.uint64)))
            size = b.column("size").to_numpy()
            own = [b.column("doc_id"), b.column("size"), pa.array(whole), pa.array(target.astype(float)), pa.array(copies), pa.array(copies * size), b.column("source"), *(b.column(k) for k in kept)]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "size", "source_size", "target", "copies", "taken", "source", *kept])

    return look


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
