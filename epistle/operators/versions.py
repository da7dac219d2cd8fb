"""Tables that change together: layers of rows in a folder, and a manifest that names which of them count.

A change stages its layers first and is in force with one small file of the manifest, written last. Whoever reads meanwhile, or
after the writer was killed half-way, has the version before of all tables; the next writer takes the dead one's number and
overwrites what it left. A layer holds a key's rows as they are now and the keys that it replaces, so that a change writes
what it touches, reads leave out what later layers replaced, and ``compact`` folds the layers into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_MANIFEST = "version long, `table` string, layer long, key string, columns string"


class Versions:
    """Versioned tables under ``path``, a folder that executors and driver share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self, version: int | None = None) -> list[dict]:
        """The rows of a version's manifest, the latest's if none is named: one for each layer of each table."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return []
        rows = [r.asDict() for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()]  # one row a layer
        last = max((r["version"] for r in rows), default=0) if version is None else version
        return [r for r in rows if r["version"] == last]

    def version(self) -> int:
        """The version in force; 0 where nothing was written yet."""
        return max((r["version"] for r in self.manifest()), default=0)

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        """The rows of a table as of a version; null where it has none."""
        own = sorted((r for r in self.manifest(version) if r["table"] == name), key=lambda r: r["layer"])
        if not own:
            return None
        layers = [self._rows(name, r) for r in own]
        gone = [self._gone(name, r) for r in own]
        out = []
        for i, rows in enumerate(layers):
            if i + 1 < len(own):
                # keys that later layers replaced; read as one table, so one join for a layer
                later = reduce(DataFrame.union, gone[i + 1 :]).distinct()
                rows = rows.join(later, own[i]["key"], "left_anti").select(layers[i].columns)
            out.append(rows)
        return reduce(DataFrame.unionByName, out)

    def commit(self, changes: dict[str, tuple[DataFrame, str, DataFrame | None]], stop_before: str | None = None) -> int:
        """Write a new version: for each table (rows, key, replaced keys), null keys meaning that the rows are the whole table.

        Tables that are not named stay as they are. ``stop_before`` ends the writing before a table, as a lost driver would (for tests).
        """
        before = self.manifest()
        number = max((r["version"] for r in before), default=0) + 1
        entries = [(number, r["table"], r["layer"], r["key"], r["columns"]) for r in before if r["table"] not in changes or changes[r["table"]][2] is not None]
        for name, (rows, key, replaced) in changes.items():
            if name == stop_before:
                raise RuntimeError(f"stopped before {name}")
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/rows={number}")
            if replaced is not None:
                replaced.select(key).distinct().write.mode("overwrite").parquet(f"{self.path}/{name}/gone={number}")
            entries.append((number, name, number if replaced is not None else -number, key, rows._jdf.schema().toDDL()))
        if stop_before == "manifest":
            raise RuntimeError("stopped before manifest")
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={number}")
        return number

    def compact(self) -> int:
        """A version whose tables have one layer each, with the same rows; folders of older versions stay until their owner deletes them."""
        names = {r["table"]: r["key"] for r in self.manifest()}
        return self.commit({name: (self.table(name), key, None) for name, key in names.items()})

    def layers(self, name: str) -> int:
        return sum(r["table"] == name for r in self.manifest())

    def _rows(self, name: str, r: dict) -> DataFrame:
        return self.spark.read.schema(r["columns"]).parquet(f"{self.path}/{name}/rows={abs(r['layer'])}")

    def _gone(self, name: str, r: dict) -> DataFrame:
        kind = self._rows(name, r).schema[r["key"]].dataType.simpleString()
        if r["layer"] < 0:  # a whole table: nothing of it is replaced by itself
            return self.spark.createDataFrame([], f"`{r['key']}` {kind}")
        return self.spark.read.schema(f"`{r['key']}` {kind}").parquet(f"{self.path}/{name}/gone={r['layer']}")

