"""State kept between runs: keyed tables in a folder that change together.

A commit writes new parts of any of the tables and then one small file that names the parts of all of them, so readers see
all changes of a commit or none, and a commit that breaks off leaves nothing behind that anyone reads. A merge writes only
what changed; after ``DELTAS`` of them a table is written whole again. Everything goes through Hadoop's file systems, so
the folder may be on any storage that the cluster reaches. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import drop_folder, get_text, names_in, new_text

#: Parts of a table beside its first before they are put together.
DELTAS = 8
#: Commits whose parts stay for readers that started before the last commit.
KEPT = 2


class State:
    """``tables`` names each table's schema and key column."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, str]]):
        self.spark, self.folder, self.tables = spark, folder, tables

    def table(self, name: str) -> Table:
        return Table(self, name)

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.folder}/commits") if n.endswith(".json") and n[0].isdigit())

    def _commit_of(self, number: int) -> dict:
        return json.loads(get_text(self.spark, f"{self.folder}/commits/{number:012d}.json"))

    def head(self) -> dict:
        """The last commit: number, tables (name to parts), marks."""
        numbers = self._numbers()
        return self._commit_of(numbers[-1]) if numbers else {"number": 0, "tables": {}, "marks": {}}

    def marks(self) -> dict:
        """Small values that were committed together with the tables."""
        return self.head()["marks"]

    def columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], self.tables[name][0]).columns

    def read(self, name: str) -> DataFrame:
        return self._read(name, self.head()["tables"].get(name, []))

    def _read(self, name: str, parts: list[str]) -> DataFrame:
        schema, key = self.tables[name]
        columns = self.columns(name)
        if not parts:
            return self.spark.createDataFrame([], schema)
        each = [self.spark.read.schema(f"{schema}, _gone boolean").parquet(f"{self.folder}/{p}") for p in parts]
        if len(each) == 1:
            return each[0].where("not _gone").select(*columns)
        both = reduce(DataFrame.unionByName, [d.withColumn("_part", F.lit(n)) for n, d in enumerate(each)])
        rest = [c for c in columns if c != key]
        last = both.groupBy(key).agg(F.max_by(F.struct(*rest, "_gone"), "_part").alias("_last"))
        return last.where("not _last._gone").select(*[F.col(key) if c == key else F.col(f"_last.{c}").alias(c) for c in columns])

    def _write(self, name: str, rows: DataFrame) -> str:
        part = f"{name}/{uuid.uuid4().hex}"
        rows.select(*self.columns(name), "_gone").write.parquet(f"{self.folder}/{part}")
        return part

    def commit(self, whole: dict[str, DataFrame] | None = None, puts: dict[str, DataFrame] | None = None, deletes: dict[str, DataFrame] | None = None, marks: dict | None = None) -> None:
        """Changes any of the tables at once: ``whole`` replaces one, ``puts`` replace rows of their key, then keys of ``deletes`` go.

        Of several puts with one key any one holds. Rows with a null key are not kept.
        """
        head = self.head()
        tables = dict(head["tables"])
        for name, rows in (whole or {}).items():
            tables[name] = [self._write(name, rows.withColumn("_gone", F.lit(False)))]
        for name in {*(puts or {}), *(deletes or {})}:
            key, columns = self.tables[name][1], self.columns(name)
            empty = self.spark.createDataFrame([], self.tables[name][0])
            new = (puts or {}).get(name, empty).select(*columns).where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_gone", F.lit(False))
            gone = (deletes or {}).get(name)
            if gone is not None:
                gone = gone.select(key).where(F.col(key).isNotNull()).distinct()
                new = new.join(gone, key, "left_anti").select(*columns, "_gone").unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
            parts = [*tables.get(name, []), self._write(name, new)]
            if len(parts) > DELTAS:
                parts = [self._write(name, self._read(name, parts).withColumn("_gone", F.lit(False)))]
            tables[name] = parts
        number = head["number"] + 1
        commit = {"number": number, "tables": tables, "marks": head["marks"] | (marks or {})}
        if not new_text(self.spark, f"{self.folder}/commits/{number:012d}.json", json.dumps(commit)):
            raise RuntimeError(f"commit {number} of {self.folder} was made by another writer")
        self._forget()

    def _forget(self) -> None:
        """Removes what no kept commit names: parts of older commits and of commits that broke off."""
        numbers = self._numbers()
        used = {p for n in numbers[-KEPT:] for parts in self._commit_of(n)["tables"].values() for p in parts}
        for n in numbers[:-KEPT]:
            drop_folder(self.spark, f"{self.folder}/commits/{n:012d}.json")
        for name in self.tables:
            for part in names_in(self.spark, f"{self.folder}/{name}"):
                if f"{name}/{part}" not in used:
                    drop_folder(self.spark, f"{self.folder}/{name}/{part}")


class Table:
    """One table of a state."""

    def __init__(self, state: State, name: str):
        self.state, self.name = state, name

    @property
    def version(self) -> int:
        return self.state.head()["number"]

    def read(self) -> DataFrame:
        """The current rows; none before the first commit."""
        return self.state.read(self.name)

    def get(self, key: str) -> DataFrame:
        return self.read().where(F.col(self.state.tables[self.name][1]) == key)

    def overwrite(self, rows: DataFrame) -> None:
        """Commits ``rows`` as the whole table."""
        self.state.commit(whole={self.name: rows})

    def merge(self, puts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """Puts replace rows of their key, then keys of ``deletes`` go. Nothing to do is no commit."""
        if puts is not None or deletes is not None:
            self.state.commit(puts={self.name: puts} if puts is not None else None, deletes={self.name: deletes} if deletes is not None else None)


class Snapshots(Table):
    """A state of one table."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str):
        super().__init__(State(spark, folder, {"rows": (schema, key)}), "rows")
