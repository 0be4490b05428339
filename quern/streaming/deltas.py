"""Views that follow changes: what a micro-batch changes goes through a join and folds, and only the buckets of its keys are written anew.

A change is a row with a column `sign`: 1 brings the row, -1 takes it away; a correction is one of each. Everything that is kept is a
table of amounts that add up (rows and how often they stand; strips of exact sums; values and how often they occur, for the
least and greatest), so changes of any order and number lead to the same table. Tables lie in the shared folder in buckets by key. A
version is a list of the buckets' folders, put in place whole: a batch that runs again finds the version before its own, and leaves the same.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QuernError
from ..operators import exact
from ..shared import saved

BUCKETS = 64
AMOUNT = T.DecimalType(38, 0)


class Kept:
    """Rows and their amounts, in buckets by `keys`; schema is that of the rows. Whole amounts that only count rows may be longs."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str | T.StructType, buckets: int = BUCKETS, amount: T.DataType = AMOUNT):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = [f.name for f in own]
        self.amount, self.schema = amount, T.StructType([*own.fields, T.StructField("amount", amount)])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets of some rows' keys: no more numbers than there are buckets."""
        return sorted(r[0] for r in changes.select(self.bucket()).distinct().collect())

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []

    def folders(self, before: int | None = None) -> dict[int, str]:
        """Of each bucket the folder that holds it, in the last version (before one, if given)."""
        own = [v for v in self.versions() if before is None or v < before]
        if not own:
            return {}
        fs, at = self._fs(f"{self.path}/versions/{own[-1]}")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def rows(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        folders = self.folders(before)
        paths = [f for b, f in folders.items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def part(self) -> Column:
        """Rows of a bucket are dealt further, so a version takes as many tasks as the session has, however few the buckets or the keys."""
        n = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        return F.pmod(F.xxhash64(*self.columns), F.lit(n)).cast("int")

    def apply(self, batch: int, changes: DataFrame, own: list[int] | None = None) -> list[int]:
        """Add changes (rows, amount) to the version before `batch`, as that version; gives the buckets written (`own`, where known). A batch that is there already stays."""
        own = self.touched(changes) if own is None else own
        if batch in self.versions():
            return own
        if any(v > batch for v in self.versions()):
            raise QuernError("batch_order", f"batch {batch} after {self.versions()[-1]}")
        folders = self.folders(batch)
        if own:
            rows = self.rows(batch, own).unionByName(changes.select(*self.columns, F.col("amount").cast(self.amount).alias("amount")))
            # Dealt once, by what both the sums and the folders need.
            dealt = rows.withColumns({"__bucket": self.bucket(), "__part": self.part()}).repartition("__bucket", "__part")
            summed = dealt.groupBy("__bucket", "__part", *self.columns).agg(F.sum("amount").cast(self.amount).alias("amount")).where("amount <> 0")
            summed.drop("__part").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/batch={batch}")
            fs, _ = self._fs(self.path)
            for b in own:
                at = f"{self.path}/batch={batch}/__bucket={b}"
                # A bucket whose rows all went has no folder.
                if fs.exists(self._fs(at)[1]):
                    folders[b] = at
                else:
                    folders.pop(b, None)
        self._put(batch, folders)
        return own

    def _put(self, batch: int, folders: dict[int, str]) -> None:
        fs, at = self._fs(f"{self.path}/versions/{batch}")
        _, temporary = self._fs(f"{self.path}/versions/_{batch}")
        fs.mkdirs(at.getParent())
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if not fs.rename(temporary, at):
            raise QuernError("version", f"{at}")


class FoldView:
    """Folds by key of rows that change: folds are {name: ("count" | "sum" | "min" | "max", column)}; sums are exact, rounded once.

    Keys whose rows have all gone have no row; null values take no part; a sum of none is 0.0, a least or greatest of none null.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], folds: dict[str, tuple[str, str | None]], buckets: int = BUCKETS):
        if bad := {k for k, _ in folds.values()} - {"count", "sum", "min", "max"}:
            raise QuernError("fold", f"{sorted(bad)}")
        self.keys, self.folds = list(keys), folds
        # Kept once for all folds that need it: the least and greatest of a column are read from the same values, a count of rows is there anyway.
        first: dict = {("count", None): ""}
        self.stored = {name: first.setdefault(("values" if kind in ("min", "max") else kind, column), name) for name, (kind, column) in folds.items()}
        self.kept = Kept(spark, path, self.keys, ", ".join([*(f"`{k}` {t}" for k, t in keys.items()), "fold string", "part double"]), buckets)

    def parts(self, changes: DataFrame) -> DataFrame:
        """Changes of rows as amounts that add up."""
        if any(kind in ("min", "max") for kind, _ in self.folds.values()):
            # Each different value is kept, so rows that are alike become one before they are taken apart.
            columns = [c for c in dict.fromkeys(c for _, c in self.folds.values()) if c is not None and c not in self.keys]
            changes = changes.groupBy(*self.keys, *columns).agg(F.sum("sign").alias("sign"))
        one = lambda name, part, amount: F.struct(F.lit(name).alias("fold"), part.cast("double").alias("part"), amount.cast("decimal(38,0)").alias("amount"))
        every = [one("", F.lit(0.0), F.col("sign"))]
        for name, (kind, column) in self.folds.items():
            if self.stored[name] != name:
                continue
            if kind == "sum":
                strip, digits = exact.terms(F.col(column))
                every.append(F.when(digits.isNotNull(), one(name, strip, (digits * F.col("sign").cast("decimal(18,0)")).cast("decimal(38,0)"))))
            elif kind in ("min", "max"):
                every.append(F.when(F.col(column).isNotNull(), one(name, F.col(column), F.col("sign"))))
            else:
                every.append(F.when(F.lit(True) if column is None else F.col(column).isNotNull(), one(name, F.lit(0.0), F.col("sign"))))
        rows = changes.select(*self.keys, F.explode(F.array_compact(F.array(*every))).alias("p")).select(*self.keys, "p.*")
        return rows.groupBy(*self.keys, "fold", "part").agg(F.sum("amount").cast("decimal(38,0)").alias("amount"))

    def values(self, rows: DataFrame) -> DataFrame:
        """keys and folds of kept amounts."""
        of = lambda name: F.col("fold") == name
        aggs, out = [F.max(F.when(of(""), F.col("amount"))).alias("__n")], []
        for name, (kind, _) in self.folds.items():
            kept = self.stored[name]
            if kind == "sum":
                aggs.append(F.collect_list(F.when(of(kept), F.struct(F.col("part").cast("int").alias("strip"), F.col("amount").alias("digits")))).alias(name))
                out.append(exact.rounded(F.col(name)).alias(name))
            elif kind == "count":
                aggs.append(F.max(F.when(of(kept), F.col("amount"))).alias(name))
                out.append(F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")).alias(name))
            else:
                aggs.append(getattr(F, kind)(F.when(of(kept) & (F.col("amount") > 0), F.col("part"))).alias(name))
                out.append(F.col(name))
        return rows.groupBy(*self.keys).agg(*aggs).where("__n > 0").select(*self.keys, *out)

    def refresh(self, batch: int, changes: DataFrame) -> DataFrame:
        """Take a batch's changes in; gives the keys that they touch with their new folds, read from those keys' buckets only."""
        parts = saved(self.parts(changes), "delta")
        own = self.kept.apply(batch, parts)
        return self.values(self.kept.rows(buckets=own).join(parts.select(*self.keys).distinct(), self.keys, "left_semi"))

    def current(self) -> DataFrame:
        return self.values(self.kept.rows())


class JoinedView:
    """Folds over the join of two tables that both change: a batch's own rows meet the other side, the sides never meet as a whole again.

    left and right are {column: type}; they join on the columns that both have. `body` gives the folds' columns from a joined row.
    """

    def __init__(self, spark: SparkSession, path: str, left: dict[str, str], right: dict[str, str], keys: dict[str, str], folds: dict[str, tuple[str, str | None]], body=None, buckets: int = BUCKETS):
        self.on = [c for c in left if c in right]
        if not self.on:
            raise QuernError("join_keys", "the sides share no column")
        ddl = lambda cols: ", ".join(f"`{c}` {t}" for c, t in cols.items())
        self.left, self.right = (Kept(spark, f"{path}/{name}", self.on, ddl(side), buckets, T.LongType()) for name, side in (("left", left), ("right", right)))
        self.view, self.body = FoldView(spark, f"{path}/view", keys, folds, buckets), body or (lambda df: df)

    def refresh(self, batch: int, left: DataFrame, right: DataFrame) -> DataFrame:
        """Changes of both sides: new left rows meet the right side as it was, new right rows the left side as it is now."""
        real = " and ".join(f"`{c}` is not null" for c in self.on)
        net = lambda df, kept: df.groupBy(*kept.columns).agg(F.sum("sign").alias("amount")).where("amount <> 0").where(real)
        dl, dr = saved(net(left, self.left), "delta"), saved(net(right, self.right), "delta")
        # Both sides have their buckets by the same columns.
        of_left, of_right = self.left.touched(dl), self.right.touched(dr)
        before = self.right.rows(batch, of_left)
        self.left.apply(batch, dl, of_left)
        now = self.left.rows(batch + 1, of_right)
        self.right.apply(batch, dr, of_right)
        pair = lambda a, b: a.withColumnRenamed("amount", "__a").join(b.withColumnRenamed("amount", "__b"), self.on).withColumn("sign", (F.col("__a") * F.col("__b")).cast("long")).drop("__a", "__b")
        changes = self.body(pair(dl, before).unionByName(pair(now, dr)))
        return self.view.refresh(batch, changes)

    def current(self) -> DataFrame:
        return self.view.current()
