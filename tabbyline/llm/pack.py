"""Problem 9: putting texts into containers of fixed capacity.

Method: best-two-fit. Containers are filled greedily, largest item first; then the smallest item of a
container is taken out if two unpacked items fill the widened gap more tightly, and so on while it helps.

Sizes are whole numbers of at most the capacity, so the items are a histogram of at most `capacity`
entries, whatever their number. The plan is made on that histogram: a filled container is a pattern of
sizes, repeated as often as the histogram holds it, which uses up at least one size. The plan has thus at
most a few thousand patterns. Items are then numbered within their size and look their container up in
the plan; only the (bounded) histogram and plan ever meet the driver. No item is dropped or moved through a
single task, and none is split unless it is larger than a container: such a one is cut into parts of at most
the capacity (texts at their natural boundaries, by the splitter of problem 1), which are packed like all others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tabbyline.llm.bpe import DEFAULT_VOCABULARY, encoder
from tabbyline.llm.encode import slices
from tabbyline.llm.split import cut_texts
from tabbyline.session import ensure_shipped, materialise


def _best_pair(counts: np.ndarray, gap: int) -> tuple[int, int]:
    """The two available sizes of the largest sum that fits `gap` (0, 0 if none)."""
    sizes = np.flatnonzero(counts[: gap + 1])
    best = (0, 0)
    if not len(sizes):
        return best
    partner = np.searchsorted(sizes, gap - sizes, "right") - 1
    for a, at in zip(sizes[::-1].tolist(), partner[::-1].tolist()):
        if at >= 0:
            b = int(sizes[at])
            if b == a and counts[a] < 2:
                if at == 0:
                    continue
                b = int(sizes[at - 1])
            if a + b > sum(best):
                best = (a, b)
                if a + b == gap:
                    break
    return best


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns `({size: how many}, containers)` that use up the histogram of sizes from 1 to `capacity`."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    patterns = []
    while True:
        left = np.flatnonzero(counts)
        if not len(left):
            return patterns
        taken: list[int] = []
        gap = capacity
        rest = counts.copy()
        while gap:  # greedy: the largest item that fits
            fitting = np.flatnonzero(rest[: gap + 1])
            if not len(fitting):
                break
            size = int(fitting[-1])
            taken.append(size)
            rest[size] -= 1
            gap -= size
        while gap and len(taken) > 1:  # two for the smallest
            smallest = taken[-1]
            rest[smallest] += 1
            a, b = _best_pair(rest, gap + smallest)
            if a + b <= smallest:
                rest[smallest] -= 1
                break
            rest[a] -= 1
            rest[b] -= 1
            taken = sorted([*taken[:-1], a, b], reverse=True)
            gap = capacity - sum(taken)
        sizes, need = np.unique(taken, return_counts=True)
        times = int((counts[sizes] // need).min())
        counts[sizes] -= need * times
        patterns.append((dict(zip(sizes.tolist(), need.tolist())), times))


def pack(sized: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """`(key, part, parts, size, container)` for each row of `sized`, several for an item over `capacity`.

    Such an item is cut into full parts and a rest. Items of no size (null and empty texts) take no room:
    container null. Ties are broken by the rows' place in the materialised input; repeated rows are items of
    their own; an empty input gives an empty result.
    """
    whole = sized.select(F.col(key).alias("k"), F.col(size).cast("bigint").alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    cut = whole.withColumn("parts", F.coalesce(parts, F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = F.col("n") - F.col("part") * F.lit(capacity)
    return _packed(cut.select("k", "part", "parts", F.when(rest > capacity, capacity).otherwise(rest).alias("n")), key, size, capacity)


def _packed(raw: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """`pack` for parts `(k, part, parts, n)` of at most `capacity` each."""
    raw = raw.withColumn("class", F.when(F.col("n") > 0, F.col("n")))
    items = materialise(raw.withColumns({"block": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "pack")
    filled = items.filter(F.col("class").isNotNull())
    in_parts = materialise(filled.groupBy("class", "block").count(), "pack-parts")
    histogram = {r["class"]: r["n"] for r in in_parts.groupBy("class").agg(F.sum("count").alias("n")).collect()}
    segments = np.array(sorted(_segments(plan(histogram, capacity))), np.int64).reshape(-1, 4)
    keys = segments[:, 0] * (1 << 44) + segments[:, 1]  # class and number in one, for one sorted look-up

    # A number for each item within its class: a block's items are numbered by themselves, and counts of
    # the blocks before it are added, so that a class of any size spreads over the blocks.
    before = Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_parts.select("class", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("class", "block").orderBy("place")
    # joined on the window's own keys: one exchange for both, and nothing that grows is broadcast
    numbered = filled.join(starts.hint("merge"), ["class", "block"]).withColumn("number", F.col("start") + F.row_number().over(inside) - 1)

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number = batch["number"].to_numpy()
            at = np.searchsorted(keys, batch["class"].to_numpy() * (1 << 44) + number, "right") - 1
            container = segments[at, 2] + (number - segments[at, 1]) // segments[at, 3]
            yield batch[["k", "part", "parts", "n"]].assign(container=container)

    schema = StructType([*items.select("k", "part", "parts", "n").schema.fields, StructField("container", LongType())])
    packed = numbered.select("k", "part", "parts", "n", "class", "number").mapInPandas(look_up, schema)
    rest = items.filter(F.col("class").isNull()).select("k", "part", "parts", "n", F.lit(None).cast("bigint").alias("container"))
    return packed.unionByName(rest).withColumnsRenamed({"k": key, "n": size})


def _segments(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int]]:
    """The plan by size, `(size, lo, bin, per)`: of the items of a size, those numbered from `lo` on go
    into containers from `bin` on, `per` in each."""
    out, used, bins = [], Counter(), 0
    for pattern, times in patterns:
        for n, per in pattern.items():
            out.append((n, used[n], bins, per))
            used[n] += per * times
        bins += times
    return out


def measured_parts(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """`(k, part, parts, n)`: the tokens of each text, and of the parts of those of more than `capacity`. Narrow;
    null and empty texts have no tokens."""
    ensure_shipped(df.sparkSession)
    schema = StructType([StructField("k", df.schema[key].dataType), StructField("part", IntegerType()), StructField("parts", IntegerType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, 1, 4_000_000):
                texts = batch.column(1).to_pylist()
                counts = [enc.count(t) for t in texts]
                long = [n for n, c in enumerate(counts) if c > capacity]
                cuts = dict(zip(long, cut_texts([texts[n] for n in long], enc, capacity, 0)))
                rows = [(n, i, len(pieces), c) for n in range(len(texts)) for pieces in [cuts.get(n, [(0, 0, counts[n])])] for i, (_, _, c) in enumerate(pieces)]
                table = np.array(rows, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), pa.array(table[:, 2].astype(np.int32)), pa.array(table[:, 3])], schema.names
                )

    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)


def pack_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """`pack` over texts, measured in tokens: `(key, part, parts, tokens, container)`."""
    return _packed(measured_parts(df, key, text, capacity, vocabulary), key, "tokens", capacity)


def fills(packed: DataFrame, size: str = "tokens", capacity: int = 2048) -> DataFrame:
    """`(container, items, size, room)` of each container of a packing: what it holds, and what is left."""
    held = packed.filter(F.col("container").isNotNull()).groupBy("container").agg(F.count("*").alias("items"), F.sum(size).alias(size))
    return held.withColumn("room", F.lit(capacity) - F.col(size))


def too_large(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Keys of the texts that lie in their containers in parts, being larger than one."""
    packed = pack_documents(df, key, **options).filter((F.col("parts") > 1) & F.col("container").isNotNull() & F.col(key).isNotNull())
    return packed.select(key).distinct()
