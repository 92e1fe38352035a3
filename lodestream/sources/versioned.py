"""Tables that are changed by rewriting only the files that hold changed rows.

A table is a folder of Parquet files and a list of live files per version. An
update from a join, a delete by a condition or an upsert looks for the rows that
it touches (keys only), reads the files that hold them, writes their rows anew
and lists the new files beside those that were left alone, whose names stay.
A version is committed by creating its list under the next number, which fails
if someone else has created it: the loser gets :class:`Conflict` and its files
are in no list. Readers of an older version keep what they read. On stores
without create-if-absent one writer must commit at a time.

The driver holds names of files, never rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed the version that this change was to become."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_of = spark._jvm.org.apache.hadoop.fs
        self._fs = self._fs_of.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions -----------------------------------------------------------------------------

    def _list(self, version: int):
        return self._fs_of.Path(f"{self.path}/_versions/{version:012d}")

    def version(self) -> int:
        """Number of the newest version; -1 before the first."""
        top = self._fs_of.Path(f"{self.path}/_versions")
        if not self._fs.exists(top):
            return -1
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(top) if s.getPath().getName().isdigit()), default=-1)

    def _entries(self, version: int) -> tuple[str, list[str]]:
        text = self.spark.read.text(str(self._list(version)), wholetext=True).first()[0]
        schema, *files = text.rstrip("\n").split("\n")
        return schema, files

    def files(self, version: int | None = None) -> list[str]:
        """Live files, relative to the table."""
        return self._entries(self.version() if version is None else version)[1]

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromDDL(self._entries(self.version() if version is None else version)[0])

    def read(self, version: int | None = None, files: Sequence[str] | None = None) -> DataFrame:
        """Rows of a version (the newest unless given), or of some of its files."""
        schema, live = self._entries(self.version() if version is None else version)
        chosen = [f"{self.path}/{f}" for f in (live if files is None else files)]
        return self.spark.read.schema(schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], schema)

    def _commit(self, base: int, schema: str, files: list[str]) -> int:
        at = self._list(base + 1)
        try:
            out = self._fs.create(at, False)
        except Exception as e:  # the store's "file exists", as a Java exception
            if self._fs.exists(at):
                raise Conflict(f"version {base + 1} of {self.path} is already there") from e
            raise
        out.write(bytearray("\n".join([schema, *sorted(files)]).encode()))
        out.close()
        return base + 1

    def _written(self, rows: DataFrame) -> list[str]:
        """Write rows below a name of their own; the files that hold any."""
        name = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        found = self._fs.listStatus(self._fs_of.Path(f"{self.path}/{name}"))
        return [f"{name}/{s.getPath().getName()}" for s in found if s.getPath().getName().startswith("part-")]

    # --- changes ------------------------------------------------------------------------------

    def create(self, rows: DataFrame, cluster: Sequence[str] = (), files: int | None = None) -> int:
        """The first version; rows of near ``cluster`` values lie in the same files, so that changes touch few.

        ``rows`` is computed once: ranges are drawn from a first copy, which goes when the table is there.
        """
        schema = _ddl(rows.schema)
        if not cluster:
            return self._commit(-1, schema, self._written(rows))
        count = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        copy = f"{self.path}/copy-{uuid.uuid4().hex}"
        rows.write.parquet(copy)
        dealt = self.spark.read.schema(rows.schema).parquet(copy).repartitionByRange(count, *cluster).sortWithinPartitions(*cluster)
        version = self._commit(-1, schema, self._written(dealt))
        self._fs.delete(self._fs_of.Path(copy), True)
        return version

    def append(self, rows: DataFrame) -> int:
        """Add rows; no file is rewritten."""
        base = self.version()
        schema, live = self._entries(base)
        return self._commit(base, schema, live + self._written(rows.select(*self.schema(base).fieldNames())))

    def _touched(self, rows: DataFrame) -> list[str]:
        """Files of the rows of a read that carry ``_file``; one name a file."""
        found = [r[0] for r in rows.select("_file").distinct().collect()]
        return sorted({"/".join(f.rsplit("/", 2)[-2:]) for f in found})

    def _swap(self, base: int, touched: list[str], rows: DataFrame) -> int:
        schema, live = self._entries(base)
        return self._commit(base, schema, [f for f in live if f not in set(touched)] + self._written(rows))

    def update_from(self, other: DataFrame, keys: dict[str, str], sets: dict[str, Column], where: Column | None = None) -> int:
        """UPDATE ... FROM: rows whose ``keys`` (own column: column of ``other``) match take the values of ``sets``.

        Expressions see own columns as ``t.<name>`` and the other's as ``o.<name>``; ``where`` narrows the matching
        pairs. ``other`` must hold a key once at most, else an error is raised, as the outcome would depend on order.
        Rows with a null key match nothing. Without matching rows the version stays.
        """
        base = self.version()
        narrow = list(dict.fromkeys(keys.values()))
        if other.where(" AND ".join(f"`{c}` IS NOT NULL" for c in narrow)).groupBy(*narrow).count().where("count > 1").limit(1).count():
            raise ValueError(f"the rows to update from repeat a key ({', '.join(narrow)})")
        own = self.read(base)
        on = [F.col(f"t.{a}") == F.col(f"o.{b}") for a, b in keys.items()]
        extra = [where] if where is not None else []
        pairs = own.select("*", F.col("_metadata.file_path").alias("_file")).alias("t").join(other.alias("o"), [*on, *extra], "inner")
        touched = self._touched(pairs)
        if not touched:
            return base
        names = own.columns
        rows = self.read(base, touched).alias("t").join(other.withColumn("_hit", F.lit(True)).alias("o"), [*on, *extra], "left")
        value = lambda c: F.when(F.col("o._hit"), sets[c].cast(own.schema[c].dataType)).otherwise(F.col(f"t.{c}")) if c in sets else F.col(f"t.{c}")
        return self._swap(base, touched, rows.select(*[value(c).alias(c) for c in names]))

    def delete_where(self, condition: Column, of: DataFrame | None = None, keys: dict[str, str] | None = None) -> int:
        """Delete rows for which ``condition`` is true (null counts as false), narrowed to those whose ``keys`` are in ``of``.

        A scalar subquery is an ``of`` of one row. Without rows to delete the version stays.
        """
        base = self.version()
        own = self.read(base)
        doomed = lambda df: df.where(F.coalesce(condition, F.lit(False)))
        if of is not None:
            known = of.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(keys.values())]).distinct()
            on = lambda df: [df[a] == known[f"_k{i}"] for i, a in enumerate(keys)]
        hit = doomed(own.select("*", F.col("_metadata.file_path").alias("_file")))
        touched = self._touched(hit.join(known, on(hit), "left_semi") if of is not None else hit)
        if not touched:
            return base
        rows = self.read(base, touched)
        if of is None:
            return self._swap(base, touched, rows.where(~F.coalesce(condition, F.lit(False))))
        both = rows.join(known.withColumn("_hit", F.lit(True)), on(rows), "left")
        return self._swap(base, touched, both.where(~(F.coalesce(condition, F.lit(False)) & F.coalesce("_hit", F.lit(False)))).select(*own.columns))

    def upsert(self, changes: DataFrame, keys: Sequence[str]) -> int:
        """Rows of ``changes`` (one a key) take the place of rows of their key; new keys are added in files of their own.

        ``changes`` is computed once: it is written first and looked up from there. No changes leave the version.
        """
        base = self.version()
        schema, live = self._entries(base)
        own = self.read(base)
        fresh = self._written(changes.select(*own.columns))
        named = self.read(base, fresh).select(*[F.col(k).alias(f"_{k}") for k in keys])
        if not named.limit(1).count():
            return base
        same = lambda rows: [rows[k].eqNullSafe(named[f"_{k}"]) for k in keys]
        found = own.select(*keys, F.col("_metadata.file_path").alias("_file"))
        touched = self._touched(found.join(named, same(found), "left_semi"))
        kept = self.read(base, touched)
        rest = self._written(kept.join(named, same(kept), "left_anti")) if touched else []
        return self._commit(base, schema, [f for f in live if f not in set(touched)] + rest + fresh)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
