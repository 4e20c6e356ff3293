"""Mix sources to target shares of the total tokens.

The total is the largest at which no source needs its records more often than
allowed.  It is cut into equal blocks of tokens, and Sainte-Lague apportionment
(highest quotients: a source with s blocks has the quotient weight / (2 s + 1))
gives every source an integer number of blocks, then every bunch of a source's shards, then every
shard of a bunch; only the sources, a row each, are apportioned on the driver.  A
shard is a seeded part of a source of bounded size; its records stand in seeded order,
and the first blocks of that order are taken, after as many whole passes as the quota holds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.llm.tokens import DEFAULT, TokenCounter
from cladeframe.llm.words import chunks
from cladeframe.workspace import Workspace


@dataclass(frozen=True)
class MixSpec:
    """``block`` tokens per block (less where the total has under ``least_blocks`` of them), shards of about ``shard`` tokens, ``bunch`` shards apportioned together.

    ``total`` asks for a total number of tokens; the largest possible one is taken if it is null or more.
    ``most_sources`` bounds the table of targets, which the driver reads.
    """

    vocabulary: str = DEFAULT
    block: int = 2048
    least_blocks: int = 10_000
    shard: int = 4_000_000
    bunch: int = 1024
    most_sources: int = 10_000
    total: int | None = None
    seed: int = 29


def sainte_lague(weights: list[int | float | Fraction], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 s + 1), ties to the earlier entry, at most ``most[i]`` each.

    The bulk comes from the divisor form of the method: with divisor d, entry i
    has round(weight / d) seats; a divisor that gives no more than ``seats`` is
    taken and the few seats left go by quotient, so the cost does not grow with ``seats``.
    """
    w = [Fraction(x) for x in weights]
    most = [seats if x else 0 for x in w] if most is None else [min(m, seats) if x else 0 for m, x in zip(most, w)]
    if seats >= sum(most):
        return list(most)
    total = sum(w)
    low, high = Fraction(0), 2 * total + 1  # at ``high`` nobody has a seat

    def at(d: Fraction) -> list[int]:
        return [min(m, int(x / d + Fraction(1, 2))) for x, m in zip(w, most)]

    got = [0] * len(w)
    for _ in range(80):
        d = (low + high) / 2
        d = Fraction(float(d)) if d else d
        try_ = at(d)
        if sum(try_) <= seats:
            got, high = try_, d
            if sum(got) == seats:
                break
        else:
            low = d
    heap = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if got[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return got


def token_counts(documents: DataFrame, targets: DataFrame, spec: MixSpec = MixSpec(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, source, n_tokens)`` of every document of a source with a target; null and empty texts have no token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            if not batch.num_rows:
                continue
            counter = counter or TokenCounter(spec.vocabulary)
            n = [counter.count(texts) for _, texts in chunks(zip(range(batch.num_rows), batch.column(2).to_pylist()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n))], ["doc_id", "source", "n_tokens"])

    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).select(F.col("source").alias("__s")).distinct()
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = rows.join(wanted, F.col("source") == F.col("__s"), "left_semi")
    return rows.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


_GIVEN = "source string, bunch bigint, blocks bigint"
_TAKEN = "source string, shard bigint, tokens bigint, blocks bigint, max_repeats int"


def _apportion(groups: pd.DataFrame, out: list[str]) -> pd.DataFrame:
    """The blocks of one group, ``given``, to its parts by their tokens; no part gets more than it can fill."""
    groups = groups.sort_values(out[1])
    got = sainte_lague(groups.tokens.tolist(), int(groups.given.iloc[0]), groups.limit.tolist())
    return groups.assign(blocks=got)[out]


def shard_quotas(rows: DataFrame, blocks: DataFrame, block: int, spec: MixSpec) -> DataFrame:
    """``(source, shard, tokens, blocks, max_repeats)``: a source's blocks to its bunches of shards, a bunch's to its shards.

    ``rows`` has ``(source, shard, n_tokens)``, ``blocks`` ``(source, given, max_repeats)``.  A task holds the bunches of one
    source or the shards of one bunch, never records.
    """
    per = rows.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens")).join(blocks, "source")
    per = per.withColumn("limit", F.floor(F.col("tokens") * F.col("max_repeats") / block).cast("bigint")).withColumn("bunch", F.floor(F.col("shard") / spec.bunch).cast("bigint"))
    bunches = per.groupBy("source", "bunch").agg(F.sum("tokens").alias("tokens"), F.sum("limit").alias("limit"), F.first("given").alias("given"))
    bunches = bunches.groupBy("source").applyInPandas(lambda g: _apportion(g, ["source", "bunch", "blocks"]), _GIVEN)
    shards = per.drop("given").join(bunches.withColumnRenamed("blocks", "given"), ["source", "bunch"])
    return shards.groupBy("source", "bunch").applyInPandas(lambda g: _apportion(g, ["source", "shard", "tokens", "blocks", "max_repeats"]), _TAKEN)


def mix(counts: DataFrame, targets: DataFrame, work: Workspace, spec: MixSpec = MixSpec()) -> tuple[DataFrame, DataFrame]:
    """The records used, ``(doc_id, source, n_tokens, uses)``, and the quotas, ``(source, available_tokens, quota_tokens)``.

    A source without a document or token gets no quota; the others keep their
    proportions.  A record without tokens is never used.  A source given twice,
    or with a null or non-positive share, is refused or left out.
    """
    spark = counts.sparkSession
    asked = targets.where(F.col("source").isNotNull()).select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).limit(spec.most_sources + 1).collect()
    if len(asked) > spec.most_sources or len({r.source for r in asked}) < len(asked):
        raise ValueError("targets hold a source twice, or too many sources")
    goal = {r.source: (Fraction(r.target_share), r.max_repeats) for r in asked if r.target_share and r.target_share > 0 and r.max_repeats and r.max_repeats > 0}
    sizes = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0").collect()  # one row per target at most
    have = {r.source: r.tokens for r in sizes if r.source in goal}
    names = sorted(have)
    quota_schema = "source string, available_tokens bigint, quota_tokens bigint"
    if not names:
        return counts.where("false").withColumn("uses", F.lit(0)), spark.createDataFrame([], quota_schema)
    share = sum(goal[s][0] for s in names)
    most = min(int(have[s] * goal[s][1] * share / goal[s][0]) for s in names)
    total = min(most, spec.total) if spec.total is not None else most
    block = max(1, min(spec.block, total // spec.least_blocks))
    blocks = sainte_lague([goal[s][0] for s in names], total // block, [have[s] * goal[s][1] // block for s in names])
    quota = dict(zip(names, blocks))

    each = [(s, quota[s], goal[s][1], max(1, -(-have[s] // spec.shard))) for s in names]
    given = spark.createDataFrame(each, "source string, given bigint, max_repeats int, n_shards bigint")  # one row per target
    rows = counts.where("n_tokens > 0").join(F.broadcast(given.select("source", "n_shards")), "source")
    rows = rows.withColumn("order", F.xxhash64("doc_id", F.lit(spec.seed)))
    rows = work.save(rows.withColumn("shard", F.pmod(F.col("order"), F.col("n_shards"))).drop("n_shards"), "sharded")
    taken = work.save(shard_quotas(rows, given.drop("n_shards"), block, spec), "quotas")
    rows = rows.join(taken.withColumn("quota", F.col("blocks") * block).drop("blocks"), ["source", "shard"])
    passes = F.least(F.floor(F.col("quota") / F.col("tokens")).cast("int"), F.col("max_repeats"))
    rows = rows.withColumn("passes", passes).withColumn("left", F.when(F.col("passes") < F.col("max_repeats"), F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(0))
    rows = rows.withColumn("extra", F.lit(0))
    shard, run = W.partitionBy("source", "shard"), W.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    # What the first records leave open is filled by later ones that fit, twice; the last gap by a record that is nearer to it than nothing.
    for part in (1, 1, 1, 2):
        fits = (F.col("extra") == 0) & (F.col("n_tokens") <= part * F.col("left"))
        size = F.when(fits, F.col("n_tokens")).otherwise(0)
        upto = F.sum(size).over(run)
        take = fits & ((upto <= F.col("left")) if part == 1 else (upto == F.col("n_tokens")) & (F.col("left") > 0))
        rows = rows.withColumn("now", F.when(take, 1).otherwise(0))
        rows = rows.withColumn("left", F.col("left") - F.sum(F.col("now") * F.col("n_tokens")).over(shard)).withColumn("extra", F.col("extra") + F.col("now"))
    used = rows.select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("extra")).cast("int").alias("uses")).where("uses > 0")
    return used, spark.createDataFrame([(s, have[s], quota[s] * block) for s in names], quota_schema)


def shares(used: DataFrame, quotas: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share, the limit, tokens available, the quota, tokens used, the share reached, records used and most uses of one."""
    sums = used.groupBy(F.col("source").alias("s")).agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("n_records"), F.max("uses").alias("most_uses")
    )
    every = targets.join(sums, F.col("source") == F.col("s"), "left").join(quotas.withColumnRenamed("source", "q"), F.col("source") == F.col("q"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_used = F.sum(zero("used_tokens")).over(W.partitionBy())  # over one row per target
    return every.select(
        "source", "target_share", "max_repeats", zero("available_tokens").alias("available_tokens"), zero("quota_tokens").alias("quota_tokens"),
        zero("used_tokens").alias("used_tokens"), F.when(all_used > 0, zero("used_tokens") / all_used).alias("reached_share"),
        zero("n_records").alias("n_records"), zero("most_uses").alias("most_uses"),
    )
