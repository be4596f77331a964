"""A collection of points in versioned, bucketed Parquet: create, replace, upsert, read, expire."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabbyline.functions.text import uuid5
from tabbyline.functions.vectors import usable
from tabbyline.schema import POINT
from tabbyline.session import materialise, scope

#: Points of a bucket at the first write, which sets the number of buckets unless `create` did; and the fewest buckets.
#: A bucket is rewritten as a whole when a point of it comes.
BUCKET_POINTS, LEAST_BUCKETS = 1_000_000, 8


def payload(chunks: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Points of chunks: id, vector and flat payload; missing title and url are empty strings."""
    return chunks.select(
        uuid5(F.col("id")).alias("point_id"),
        F.col("embedding").alias("vector"),
        F.col("id").alias("chunk_id"),
        "document_id",
        "source",
        "content",
        "content_type",
        "chunk_index",
        "token_count",
        F.coalesce("metadata.title", F.lit("")).alias("title"),
        F.coalesce("metadata.url", F.lit("")).alias("url"),
        *extra,
    )


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by `order`, then by all other columns that can be compared.

    An aggregate with map-side combine, so a key of many rows is no hot task."""
    rest = [c for c in df.columns if c != key and c not in order]
    last = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("__last"))
    return last.select(*(F.col(key) if c == key else F.col("__last")[c].alias(c) for c in df.columns))


class ConflictError(RuntimeError):
    """Another writer published a state first."""


class Collection:
    """A table of points below `path`.

    Points lie in buckets by the hash of their id; a version folder holds the buckets that one write has touched. A
    state file, numbered and never changed, says which version each bucket is to be read from; the highest number
    is current. It is staged, then renamed to a name that mustn't exist: readers see the old state or the new one, a
    writer that breaks off leaves the old one, and of two writers one fails with a `ConflictError` and tries again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        """Numbers of the published states, in order."""
        at = self._at("states")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def _state(self, number: int | None = None) -> dict | None:
        if number is None:
            numbers = self._numbers()
            if not numbers:
                return None
            number = numbers[-1]
        source = self._fs.open(self._at(f"states/{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")) | {"number": number}
        finally:
            source.close()

    def _publish(self, state: dict, number: int) -> None:
        staged, target = self._at(f"states/_{uuid.uuid4().hex}"), self._at(f"states/{number:012d}.json")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "number"}).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            raise ConflictError(f"state {number} of {self.path} was published by another writer")

    def create(self, dim: int = 384, recreate: bool = False, buckets: int | None = None) -> None:
        """Make an empty collection for vectors of `dim` values. An existing one is kept unless `recreate`, which
        publishes an empty state beside the old ones. buckets: how many (None: by the points of the first write)."""
        state = self._state()
        if state is None or recreate:
            self._publish({"dim": dim, "distance": "cosine", "buckets": buckets, "versions": {}}, (state["number"] if state else 0) + 1)

    def _current(self) -> dict:
        state = self._state()
        if state is None:
            raise FileNotFoundError(f"no collection at {self.path}")
        return state

    def _read(self, state: dict, buckets: list[str] | None = None) -> DataFrame:
        held = {b: v for b, v in state["versions"].items() if buckets is None or b in buckets}
        if not held:
            return self.spark.createDataFrame([], POINT)
        return self.spark.read.schema(POINT).parquet(*(f"{self.path}/{v}/bucket={b}" for b, v in held.items()))

    def points(self) -> DataFrame:
        return self._read(self._current())

    def upsert(self, chunks: DataFrame, batch: int = 100, attempts: int = 3) -> dict[str, int]:
        """Write chunks that have a usable vector; the last of equal ids wins. Only touched buckets are written again.

        Counts are of rows sent and of the batches of `batch` rows they make, of distinct points, and of rows left out for
        want of a vector; all are observed while writing."""
        with scope(self.spark):
            return self._write(chunks, batch, attempts, False)

    def replace(self, chunks: DataFrame, dim: int, batch: int = 100) -> dict[str, int]:
        """Put these chunks in the place of all points: until they are written and published, the old ones are read."""
        with scope(self.spark):
            return self._write(chunks, batch, 1, True, dim)

    def _write(self, chunks: DataFrame, batch: int, attempts: int, fresh: bool, dim: int | None = None) -> dict[str, int]:
        state = self._state() or ({"dim": dim, "distance": "cosine", "buckets": None, "versions": {}, "number": 0} if fresh else self._current())
        dim = dim or state["dim"]
        told = Observation()
        extra = ("created_at",) if "created_at" in chunks.columns else ()
        new = payload(chunks, extra)
        new = new if extra else new.withColumn("created_at", F.lit(None).cast("timestamp"))
        good = usable(F.col("vector"), dim)
        seen = new.observe(told, F.count_if(good).alias("sent"), F.count_if(~good).alias("skipped"))
        staged = materialise(latest(seen.filter(good), "point_id", "created_at"), "upsert")
        distinct = staged.count()
        for attempt in range(attempts):
            held = {} if fresh else state["versions"]
            buckets = state["buckets"] if state["buckets"] and (held or not fresh) else max(LEAST_BUCKETS, -(-distinct // BUCKET_POINTS))
            bucket = F.pmod(F.xxhash64("point_id"), F.lit(buckets)).cast("int").alias("bucket")
            points, version = staged.select(*POINT.fieldNames(), bucket), uuid.uuid4().hex
            touched = [str(r["bucket"]) for r in points.select("bucket").distinct().collect()]  # one row a bucket
            old = [b for b in touched if b in held]
            if old:
                both = self._read(state, old).withColumns({"bucket": bucket, "__new": F.lit(0)}).unionByName(points.withColumn("__new", F.lit(1)))
                points = latest(both, "point_id", "__new").drop("__new")
            if touched:
                points.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}")
            try:
                self._publish({**state, "dim": dim, "buckets": buckets, "versions": {**held, **dict.fromkeys(touched, version)}}, state["number"] + 1)
                break
            except ConflictError:
                self._fs.delete(self._at(version), True)
                if attempt + 1 == attempts:
                    raise
                state = self._current()
        sent = told.get["sent"]
        return {"sent": sent, "distinct": distinct, "skipped": told.get["skipped"], "batches": -(-sent // batch), "last_batch": (sent - 1) % batch + 1 if sent else 0}

    def expire(self, keep: int = 1) -> int:
        """Delete all states but the last `keep`, and versions that none of those reads; how many versions went. To be
        called when no reader of an older state is left."""
        numbers = self._numbers()
        kept = {v for n in numbers[-keep:] for v in self._state(n)["versions"].values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"states/{n:012d}.json"), False)
        gone = [f.getPath() for f in self._fs.listStatus(self._root) if f.getPath().getName() not in kept | {"states"}]
        for at in gone:
            self._fs.delete(at, True)
        return len(gone)
