"""Percentiles per group from daily summaries that can be combined.

A summary holds, for one group and one ``run_day``, its sorted values; a day
part of more than ``POINTS`` values keeps that many equally deep ones, each
standing for its share of the rows.  Summaries of other partitions, files
or days are combined by putting them side by side: nothing is recomputed, and
the stated rank error of a combination is the sum of those of its parts (0 where no part was
thinned).

The percentiles are chosen by distributed multi-select.  Each partition
proposes, for every group and wanted rank, the median of its own values that are
still in play; the weighted median of the proposals is the pivot; all
partitions count three ways (below, equal, above); the two ranges that cannot
hold the rank are discarded; and so on until the rank falls on a pivot or so few
values are left in play (``DIRECT``, as many as one summary may hold) that sending them costs no more than another round.  Values of large groups never
move: only proposals and counts are shuffled.  Each round discards a quarter of the
values at least, whatever their distribution.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.workspace import Workspace

PROBABILITIES = (0.01, 0.05, 0.5, 0.95, 0.99)
NAMES = ("p01", "p05", "p50", "p95", "p99")
#: Most points that a summary keeps of one group's day in one partition.
POINTS = 4096
#: A rank with so many points in play, or fewer, is finished by sorting them; the result is the same for any number, 0 too.
DIRECT = POINTS
#: Rows that a partition summarises at once.
CHUNK = 1_000_000
_EPOCH = "1970-01-01"


def finite_values(ledger: DataFrame, value: str = "numeric_value", available: str = "numeric_available", day: str = "run_day") -> DataFrame:
    """``(gene_id, coordinate_id, day, value)`` of available rows with a finite value; a null day is kept as one day."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (v != float("inf")) & (v != float("-inf"))
    return ledger.where(F.col(available) & finite).select(
        "gene_id", "coordinate_id", F.coalesce(F.datediff(F.col(day), F.lit(_EPOCH).cast("date")), F.lit(-(2**31))).alias("day"), v.cast("double").alias("value")
    )


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of ``data`` as binary values, without a copy of each."""
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The binary values of a column as one array, and the number of elements of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    every = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(kind) if data is not None else np.zeros(0, kind)
    return every, np.diff(offsets) // size


def _weights(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Rows that each kept point of a day part stands for: ``rows`` spread evenly over ``points``."""
    if (rows == points).all():
        return np.ones(points.sum(), np.int64)
    j = np.arange(points.sum()) - np.repeat(np.cumsum(points) - points, points)
    n, k = np.repeat(rows, points), np.repeat(points, points)
    return (j + 1) * n // k - j * n // k


def _summarise(gene: pa.Array, coordinate: pa.Array, day: np.ndarray, value: np.ndarray, points: int) -> pa.RecordBatch:
    g, c = gene.dictionary_encode("encode"), coordinate.dictionary_encode("encode")
    gi, ci = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (g, c))
    pair = gi * len(c.dictionary) + ci
    order = np.lexsort((value, day, pair))
    pair, day, value = pair[order], day[order], value[order]
    new_pair = np.concatenate([[True], pair[1:] != pair[:-1]])
    new_day = new_pair | np.concatenate([[True], day[1:] != day[:-1]])
    first = np.flatnonzero(new_day)
    rows = np.diff(np.append(first, len(value)))
    kept = np.minimum(rows, points)
    if (rows > points).any():
        j = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
        n, k = np.repeat(rows, kept), np.repeat(kept, kept)
        value = value[np.repeat(first, kept) + (j * n // k + ((j + 1) * n // k) - 1) // 2]
    starts = np.flatnonzero(new_pair[first])
    bounds = np.append(starts, len(first))
    ends = np.concatenate([[0], np.cumsum(kept)])[bounds]
    at = first[starts]
    return pa.RecordBatch.from_arrays(
        [
            g.dictionary.take(pa.array(gi[order][at])), c.dictionary.take(pa.array(ci[order][at])),
            pa.array(np.add.reduceat(rows, starts)), pa.array(np.add.reduceat(kept, starts)),
            pa.array(np.add.reduceat(np.where(rows > kept, -(-rows // kept), 0), starts)),
            _binary(day[first].astype(np.int32), bounds), _binary(rows.astype(np.int32), bounds), _binary(value, ends),
        ],
        ["gene_id", "coordinate_id", "n", "points", "rank_error", "days", "day_rows", "data"],
    )


_SUMMARY = "gene_id string, coordinate_id string, n bigint, points bigint, rank_error bigint, days binary, day_rows binary, data binary"


def summarise(values: DataFrame, points: int = POINTS, chunk: int = CHUNK) -> DataFrame:
    """Daily summaries of every (gene, coordinate) pair, made where the rows lie, without a shuffle.

    One row per pair and run of ``chunk`` rows; within it the days (``days``,
    ``day_rows``) and the sorted values of each (``data``; ``points`` at most).
    Any set of such rows is a summary of the rows that went into it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            cols = [t.column(i).combine_chunks() for i in range(4)]
            out = _summarise(cols[0], cols[1], cols[2].to_numpy(zero_copy_only=False), cols[3].to_numpy(zero_copy_only=False), points)
            yield from (out.slice(i, 20_000) for i in range(0, out.num_rows, 20_000))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= chunk:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return values.mapInArrow(run, _SUMMARY)


def _part(name: str) -> Column:
    c = F.col(name)
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def _grouped(summaries: DataFrame) -> DataFrame:
    """Each summary row for each grouping: ``key`` is an exact text of the group; a column not grouped by is null."""
    null = F.lit(None).cast("string")
    kinds = (
        ("gene", F.col("gene_id"), null, F.concat(F.lit("g"), _part("gene_id"))),
        ("coordinate", null, F.col("coordinate_id"), F.concat(F.lit("c"), _part("coordinate_id"))),
        ("pair", F.col("gene_id"), F.col("coordinate_id"), F.concat(F.lit("p"), _part("gene_id"), _part("coordinate_id"))),
    )
    structs = [F.struct(F.lit(g).alias("grouping"), x.alias("gene"), y.alias("coordinate"), k.alias("key")) for g, x, y, k in kinds]
    return summaries.withColumn("of", F.explode(F.array(*structs))).select("of.*", "n", "points", "rank_error", "day_rows", "data")


def _sorted_groups(code: np.ndarray, day_rows: pa.Array, data: pa.Array, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and weights of summary rows, sorted by group; ``code`` is each row's group."""
    values, n = _flat(data, np.float64)
    rows, days = _flat(day_rows, np.int32)
    rows = rows.astype(np.int64)
    # Points of each day part: all its rows, or the cap, found from the row's number of points.
    points = np.minimum(rows, cap)
    group = np.repeat(code, n)
    order = np.lexsort((values, group))
    return group[order], values[order], _weights(rows, points)[order]


def _ranks(n: np.ndarray) -> np.ndarray:
    """The two ranks (from 0) around each probability, for groups of ``n`` rows: shape (len(n), 2 * probabilities)."""
    h = (n[:, None] - 1) * np.array(PROBABILITIES)
    low = np.floor(h).astype(np.int64)
    return np.concatenate([low, np.minimum(low + 1, n[:, None] - 1)], 1)


def _between(n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = (n[:, None] - 1) * np.array(PROBABILITIES)
    return low + (h - np.floor(h)) * (high - low)


_RESULT = "grouping string, gene string, coordinate string, n bigint, rank_error bigint, " + ", ".join(f"{x} double" for x in NAMES)


def _finish_small(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Groups that lie together in the rows: sort their values and read the ranks off."""
    held: list[pa.RecordBatch] = []
    size = 0

    def finish(t: pa.Table) -> pa.RecordBatch:
        key = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        code = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        n = np.add.reduceat(t.column("n").to_numpy(), first)
        error = np.add.reduceat(t.column("rank_error").to_numpy(), first)
        _, values, weights = _sorted_groups(code, t.column("day_rows").combine_chunks(), t.column("data").combine_chunks(), cap)
        total = np.cumsum(weights)
        at = np.searchsorted(total, (np.cumsum(n) - n)[:, None] + _ranks(n), "right")
        x = values[at]
        p = _between(n, x[:, : len(NAMES)], x[:, len(NAMES) :])
        of = [t.column(c).combine_chunks().take(pa.array(first)) for c in ("grouping", "gene", "coordinate")]
        return pa.RecordBatch.from_arrays([*of, pa.array(n), pa.array(error), *[pa.array(p[:, i]) for i in range(len(NAMES))]], ["grouping", "gene", "coordinate", "n", "rank_error", *NAMES])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(batch.column("points")).as_py()
        if size >= CHUNK:
            t = pa.Table.from_batches(held)
            last = t.column("key")[-1].as_py()
            cut = pc.index(pc.equal(t.column("key"), last), True).as_py()  # the last group may go on
            if cut:
                yield finish(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).combine_chunks().to_batches()
            size = pc.sum(t.slice(cut).column("points")).as_py()
    if held:
        yield finish(pa.Table.from_batches(held))


def _to_runs(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Summary rows of large groups to sorted runs ``(key, data, weight)``: one per group and ``CHUNK`` points of a partition."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        enc = t.column("key").combine_chunks().dictionary_encode()
        group, values, weights = _sorted_groups(
            enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), t.column("day_rows").combine_chunks(), t.column("data").combine_chunks(), cap
        )
        bounds = np.searchsorted(group, np.arange(len(enc.dictionary) + 1))
        return pa.RecordBatch.from_arrays([enc.dictionary, _binary(values, bounds), _binary(weights.astype(np.int32), bounds)], ["key", "data", "weight"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += pc.sum(batch.column("points")).as_py()
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


_VOTES = "key string, t int, less bigint, equal bigint, low_median double, low_weight bigint, low_points bigint, high_median double, high_weight bigint, high_points bigint"


class _Runs:
    """The sorted runs of a batch side by side, and what is asked of each: all searches are one search over (run, value)."""

    def __init__(self, batch: pa.RecordBatch):
        self.key = batch.column("key")
        self.values, self.n = _flat(batch.column("data"), np.float64)
        self.weights, _ = _flat(batch.column("weight"), np.int32)
        asked = batch.column("asked")
        flat, times = asked.flatten(), asked.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.run = np.repeat(np.arange(batch.num_rows), times)
        self.t = flat.field("t").to_numpy(zero_copy_only=False)
        self.low, self.high, self.pivot = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("low", "high", "pivot"))
        self.distinct, rank = np.unique(self.values, return_inverse=True)
        self.place = np.repeat(np.arange(batch.num_rows), self.n) * (len(self.distinct) + 1) + rank.ravel()

    def find(self, asked: np.ndarray, side: str) -> np.ndarray:
        """Where, in ``values``, what is asked of each run stands."""
        return np.searchsorted(self.place, self.run * (len(self.distinct) + 1) + np.searchsorted(self.distinct, asked, side), "left")

    def in_play(self) -> tuple[np.ndarray, np.ndarray]:
        a = self.find(self.low, "right")
        return a, np.maximum(self.find(self.high, "left"), a)


def _median(values: np.ndarray, upto: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted medians and weights of the stretches ``[a, b)`` of sorted values; ``upto`` has the weight before each place."""
    i = np.searchsorted(upto, (upto[a] + upto[b]) // 2, "right") - 1
    return values[np.clip(i, a, np.maximum(b - 1, a)).clip(0, max(len(values) - 1, 0))], upto[b] - upto[a]


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every group and wanted rank: counts three ways around the pivot, and the median of what lies on either side in play.

    The proposals of a batch's runs become one by their weighted median, so a task sends few.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        r = _Runs(batch)
        if not len(r.values):
            continue
        total = np.concatenate([[0], np.cumsum(r.weights, dtype=np.int64)])
        a, b = r.in_play()
        x, y = (np.clip(r.find(r.pivot, side), a, b) for side in ("left", "right"))
        sides = [_median(r.values, total, a, x), _median(r.values, total, y, b)]
        # One row of the batch's runs for each group and rank.
        keys = r.key.dictionary_encode()
        group = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)[r.run] * 1000 + r.t
        distinct, of = np.unique(group, return_inverse=True)
        add = lambda v: np.bincount(of, v.astype(float), len(distinct)).astype(np.int64)  # noqa: E731  exact below 2^53
        out = [keys.dictionary.take(pa.array(distinct // 1000)), pa.array((distinct % 1000).astype(np.int32)), pa.array(add(total[x] - total[a])), pa.array(add(total[y] - total[x]))]
        for (value, weight), points in zip(sides, (x - a, b - y)):
            order = np.lexsort((value, of))
            upto = np.concatenate([[0], np.cumsum(weight[order])])
            ends = np.searchsorted(of[order], np.arange(len(distinct) + 1))
            median, held = _median(value[order], upto, ends[:-1], ends[1:])
            out += [pa.array(median, mask=held == 0), pa.array(held), pa.array(add(points))]
        yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in _VOTES.split(", ")])


def _discard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs without the values that no wanted rank of their group can be."""
    for batch in batches:
        if not batch.num_rows:
            continue
        r = _Runs(batch)
        a, b = r.in_play()
        keep = np.bincount(a, minlength=len(r.values) + 1) - np.bincount(b, minlength=len(r.values) + 1)
        mask = np.cumsum(keep)[: len(r.values)] > 0
        left = np.add.reduceat(np.append(mask, False).astype(np.int64), np.concatenate([[0], np.cumsum(r.n)[:-1]])) * (r.n > 0)
        some = np.flatnonzero(left)
        if len(some):
            bounds = np.concatenate([[0], np.cumsum(left[some])])
            yield pa.RecordBatch.from_arrays([r.key.take(pa.array(some)), _binary(r.values[mask], bounds), _binary(r.weights[mask], bounds)], ["key", "data", "weight"])


def _in_play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values in play of every wanted rank, as ``(key, t, data, weight)``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        r = _Runs(batch)
        a, b = r.in_play()
        some = np.flatnonzero(b > a)
        if len(some):
            n = (b - a)[some]
            bounds = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(a[some] - bounds[:-1], n) + np.arange(bounds[-1])
            yield pa.RecordBatch.from_arrays([r.key.take(pa.array(r.run[some])), pa.array(r.t[some].astype(np.int32)), _binary(r.values[at], bounds), _binary(r.weights[at], bounds)], ["key", "t", "data", "weight"])


def _weighted_median(side: str) -> Column:
    """The proposal at which half of the weight of all proposals is reached; one proposal per batch of a task."""
    every = F.array_sort(F.collect_list(F.when(F.col(f"{side}_weight") > 0, F.struct(F.col(f"{side}_median").alias("m"), F.col(f"{side}_weight").alias("w")))))
    half = F.sum(f"{side}_weight") / 2
    start = F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(None).cast("double").alias("m"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(acc["w"] >= half, acc).otherwise(F.struct((acc["w"] + x["w"]).alias("w"), x["m"].alias("m")))

    return F.aggregate(every, start, step)["m"]


def _finish_rank(keys: tuple, t: pa.Table) -> pa.Table:
    values, n = _flat(t.column("data"), np.float64)
    weights, _ = _flat(t.column("weight"), np.int32)
    order = np.argsort(values, kind="stable")
    at = np.searchsorted(np.cumsum(weights[order], dtype=np.int64), t.column("rank")[0].as_py(), "right")
    return pa.table({"key": [keys[0].as_py()], "t": pa.array([keys[1].as_py()], pa.int32()), "found": [float(values[order][at])]})


def _multi_select(runs: DataFrame, groups: DataFrame, work: Workspace, direct: int) -> DataFrame:
    """``(key, t, found)``: the value at each wanted rank of the groups in ``runs``."""
    low = [F.floor((F.col("n") - 1) * F.lit(p)).cast("bigint") for p in PROBABILITIES]
    every = low + [F.least(x + 1, F.col("n") - 1) for x in low]
    state = groups.select("key", F.posexplode(F.array(*every)).alias("t", "rank"))
    inf = float("inf")
    state = state.select("key", "t", "rank", F.lit(-inf).alias("low"), F.lit(inf).alias("high"), F.lit(-inf).alias("pivot"))
    state = work.save(state, "state-0")
    found: list[DataFrame] = []
    k = 0
    while True:
        k += 1
        asked = state.groupBy("key").agg(F.collect_list(F.struct("t", "low", "high", "pivot")).alias("asked"))
        votes = runs.join(asked, "key").mapInArrow(_vote, _VOTES)
        told = votes.groupBy("key", "t").agg(
            F.sum("less").alias("less"), F.sum("equal").alias("equal"), _weighted_median("low").alias("low_pivot"), _weighted_median("high").alias("high_pivot"),
            F.sum("low_points").alias("low_points"), F.sum("high_points").alias("high_points"),
        )
        below, hit = F.col("rank") < F.col("less"), F.col("rank") < F.col("less") + F.col("equal")
        after = work.save(
            state.join(told, ["key", "t"]).select(
                "key", "t", F.when(below, F.col("rank")).otherwise(F.col("rank") - F.col("less") - F.col("equal")).alias("rank"),
                F.when(below, F.col("low")).otherwise(F.col("pivot")).alias("low"), F.when(below, F.col("pivot")).otherwise(F.col("high")).alias("high"),
                F.when(below, F.col("low_pivot")).otherwise(F.col("high_pivot")).alias("pivot"),
                F.when(~below & hit, F.col("pivot")).alias("found"), F.when(below, F.col("low_points")).otherwise(F.col("high_points")).alias("points"),
            ),
            f"told-{k}",
        )
        found.append(after.where("found IS NOT NULL").select("key", "t", "found"))
        state = after.where("found IS NULL")
        most = state.agg(F.max("points")).first()[0]
        if most is None or most <= direct:
            break
        if k % 2 == 0:
            asked = state.groupBy("key").agg(F.collect_list(F.struct("t", "low", "high", "pivot")).alias("asked"))
            runs = work.save(runs.join(asked, "key").mapInArrow(_discard, "key string, data binary, weight binary"), f"runs-{k}")
            work.drop(f"runs-{k - 2}")
    if most is not None:
        asked = state.groupBy("key").agg(F.collect_list(F.struct("t", "low", "high", "pivot")).alias("asked"))
        left = runs.join(asked, "key").mapInArrow(_in_play, "key string, t int, data binary, weight binary")
        left = left.join(state.select("key", "t", "rank"), ["key", "t"])
        found.append(left.groupBy("key", "t").applyInArrow(_finish_rank, "key string, t int, found double"))
    return reduce(DataFrame.unionByName, found)


def percentiles(summaries: DataFrame, work: Workspace, cap: int = POINTS, direct: int = DIRECT) -> DataFrame:
    """``(grouping, gene_id, coordinate_id, n, rank_error, p01 .. p99)`` per gene, per coordinate and per pair.

    Linear interpolation between the two nearest ranks.  ``rank_error`` bounds
    by how many ranks a value may be off: 0 says exact.  ``cap`` is the number of points the
    summaries were made with.  A null gene or coordinate is a group; no rows give no groups.
    """
    summaries = work.save(summaries, "summaries")
    grouped = _grouped(summaries)
    totals = grouped.groupBy("grouping", "gene", "coordinate", "key").agg(F.sum("n").alias("n"), F.sum("points").alias("points"), F.sum("rank_error").alias("rank_error"))
    totals = work.save(totals, "totals")
    large = work.save(totals.where(F.col("points") > direct), "large")
    points = totals.where(F.col("points") <= direct).agg(F.sum("points")).first()[0] or 0
    tasks = max(work.spark.sparkContext.defaultParallelism, -(-points // CHUNK))
    small = grouped.join(large.select("key"), "key", "left_anti").repartition(tasks, "key").sortWithinPartitions("key")
    out = small.mapInArrow(lambda b: _finish_small(b, cap), _RESULT)
    if not large.isEmpty():
        runs = work.save(grouped.join(large.select("key"), "key").mapInArrow(lambda b: _to_runs(b, cap), "key string, data binary, weight binary"), "runs-0")
        found = _multi_select(runs, large, work, direct)
        k = len(PROBABILITIES)
        wide = found.groupBy("key").agg(*[F.max(F.when(F.col("t") == i, F.col("found"))).alias(f"x{i}") for i in range(2 * k)])
        h = [(F.col("n") - 1) * F.lit(p) for p in PROBABILITIES]
        values = [(F.col(f"x{i}") + (h[i] - F.floor(h[i])) * (F.col(f"x{i + k}") - F.col(f"x{i}"))).alias(NAMES[i]) for i in range(k)]
        out = out.unionByName(large.join(wide, "key").select("grouping", "gene", "coordinate", "n", "rank_error", *values))
    return out.withColumnsRenamed({"gene": "gene_id", "coordinate": "coordinate_id"})


def day_summaries(summaries: DataFrame) -> DataFrame:
    """The summaries as one row per pair and day, days of several partitions combined: rows and kept points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            days, parts = _flat(b.column("days"), np.int32)
            rows, _ = _flat(b.column("day_rows"), np.int32)
            of = np.repeat(np.arange(b.num_rows), parts)
            values, _ = _flat(b.column("data"), np.float64)
            kept = np.minimum(rows, POINTS).astype(np.int64)
            ends = np.cumsum(kept)
            yield pa.RecordBatch.from_arrays(
                [b.column("gene_id").take(pa.array(of)), b.column("coordinate_id").take(pa.array(of)), pa.array(days), pa.array(rows.astype(np.int64)), pa.array(values[ends - kept]), pa.array(values[ends - 1])],
                ["gene_id", "coordinate_id", "day", "n", "least", "most"],
            )

    parts = summaries.mapInArrow(run, "gene_id string, coordinate_id string, day int, n bigint, least double, most double")
    day = F.when(F.col("day") != -(2**31), F.date_add(F.lit(_EPOCH).cast("date"), F.col("day")))
    return parts.groupBy("gene_id", "coordinate_id", "day").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).select(
        "gene_id", "coordinate_id", day.alias("run_day"), "n", "least", "most"
    )
