"""Splits, samples and interleavings by hash rank: deterministic, independent of input order, nested by construction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_digest


def rank(rows: DataFrame, by: list[str], row_id: str, *seed: str) -> Column:
    """1-based place of a row in its group in the order of its digest; ties by id."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(stable_digest(*seed, F.col(row_id)), F.col(row_id)))


def stratified_group_split(rows: DataFrame, key: str, scene: str, row_id: str, ratio: float, seed: str) -> DataFrame:
    """M1: whole groups of equal key go to validation until a scene's share is reached; a scene's last group never goes.

    A group's scene is that of its row of least id. If no scene can give a group, the group of least key goes.
    """
    groups = rows.groupBy(key).agg(F.min_by(F.coalesce(F.col(scene), F.lit("unknown")), row_id).alias("__s"), F.count("*").alias("__n"))
    order = Window.partitionBy("__s").orderBy(stable_digest(seed, F.col(key)), key)
    whole = Window.partitionBy("__s")
    ranked = (
        groups.withColumn("__k", F.row_number().over(order))
        .withColumn("__before", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__groups", F.count("*").over(whole))
        .withColumn("__target", F.greatest(F.lit(1), F.bround(F.sum("__n").over(whole) * ratio)))
    )
    chosen = ranked.withColumn("__v", (F.col("__before") < F.col("__target")) & (F.col("__k") < F.col("__groups")))
    state = chosen.agg(F.max(F.col("__v").cast("int")).alias("any"), F.count("*").alias("n"), F.min(key).alias("least"))
    out = chosen.crossJoin(F.broadcast(state)).withColumn("split", F.when(F.col("__v") | ((F.col("any") == 0) & (F.col("n") > 1) & (F.col(key) == F.col("least"))), "validation").otherwise("train"))  # one row
    return rows.join(out.select(key, "split"), key)


def round_robin(rows: DataFrame, by: str, row_id: str, seed: str) -> DataFrame:
    """Adds turn (the place in its group) and lane (the group's place); ordering by them takes groups in turn."""
    lanes = rows.groupBy(by).agg(F.count("*").alias("__n")).withColumn("lane", F.row_number().over(Window.orderBy(by))).drop("__n")  # a row for each group
    return rows.withColumn("turn", rank(rows, [by], row_id, seed)).join(lanes, by)


def stratified_probe(rows: DataFrame, scene: str, row_id: str, size: int, seed: str) -> DataFrame:
    """M2: `size` rows, scenes taken in turn."""
    return round_robin(rows, scene, row_id, seed).where(F.col("turn") <= size).orderBy("turn", scene).limit(size).drop("turn", "lane")


def panel(rows: DataFrame, by: list[str], row_id: str, size: int, seed: str) -> DataFrame:
    """The first `size` rows of each group by digest; a larger size holds a smaller one."""
    return rows.withColumn("__k", rank(rows, by, row_id, seed)).where(F.col("__k") <= size).drop("__k")


def balanced_counts(total: int, sizes: list[int]) -> list[int]:
    """M4: fills groups in turn up to their sizes until the total is reached."""
    if total > sum(sizes):
        raise ValueError("more than there is")
    out = [0] * len(sizes)
    left = total
    while left:
        open_groups = [i for i, (have, size) in enumerate(zip(out, sizes, strict=True)) if have < size]
        share = max(1, min([left // len(open_groups), *(sizes[i] - out[i] for i in open_groups)]))
        for i in open_groups:
            give = min(share, left)
            out[i] += give
            left -= give
    return out


def mix_size(base: int, fraction: float) -> int:
    """M6: rows to add so that they are `fraction` of all."""
    return round(base * fraction / (1 - fraction))


def largest_remainder(groups: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """M7: whole shares of `total` by whole weights; remainders go by size, then name. One row a group."""
    every = Window.partitionBy(F.lit(1))
    w = groups.withColumn("__w", F.sum(weight).over(every)).where("__w > 0")
    product = F.col(weight) * F.lit(int(total))
    w = w.withColumn("__floor", F.expr(f"({int(total)} * {weight}) div __w")).withColumn("__rest", product % F.col("__w"))
    w = w.withColumn("__left", F.lit(int(total)) - F.sum("__floor").over(every)).withColumn("__k", F.row_number().over(Window.orderBy(F.desc("__rest"), name)))
    return w.select(name, weight, (F.col("__floor") + (F.col("__k") <= F.col("__left")).cast("long")).cast("long").alias("share"))


def permutation(rows: DataFrame, row_id: str, *seed: str) -> DataFrame:
    """Adds position, 0-based, in digest order. One global order: rows are numbered inside digest ranges and shifted by the ranges' counts."""
    keyed = rows.withColumn("__d", stable_digest(*seed, F.col(row_id))).withColumn("__r", F.substring("__d", 1, 3))
    counts = keyed.groupBy("__r").agg(F.count("*").alias("__n"))  # at most 4096 ranges
    shift = counts.withColumn("__at", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__r").orderBy("__d", row_id)) - 1
    return keyed.withColumn("__i", inside).join(F.broadcast(shift), "__r").withColumn("position", (F.col("__i") + F.col("__at")).cast("long")).drop("__d", "__r", "__i", "__at")


def cyclic_sample(rows: DataFrame, row_id: str, count: int, epoch: int, *seed: str) -> DataFrame:
    """`count` rows of a fixed permutation that is turned on by `count` each epoch; adds draw."""
    placed = permutation(rows, row_id, *seed)
    size = placed.agg(F.count("*").alias("__n"))
    turned = placed.crossJoin(F.broadcast(size)).withColumn("draw", F.pmod(F.col("position") - F.lit(epoch * count), F.col("__n")))  # one row
    return turned.where(F.col("draw") < count).drop("__n", "position")


def repeated_sample(rows: DataFrame, row_id: str, count: int, epoch: int, *seed: str) -> DataFrame:
    """Whole permutations, each of its own cycle's seed, then a part of one; adds draw (0 to count - 1)."""
    size = rows.count()
    if not size:
        raise ValueError("nothing to draw from")
    cycles = -(-count // size)
    out = None
    for c in range(cycles):
        part = permutation(rows, row_id, *seed, str(epoch), str(c)).withColumn("draw", F.col("position") + F.lit(c * size)).drop("position")
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("draw") < count)


def batches(rows: DataFrame, row_id: str, epochs: int, size: int, seed: str) -> DataFrame:
    """Each epoch's permutation in batches; the last may be short. Adds epoch, batch, offset."""
    out = None
    for e in range(epochs):
        part = permutation(rows, row_id, seed, str(e)).select("*", F.lit(e).alias("epoch"), F.floor(F.col("position") / size).alias("batch"), (F.col("position") % size).alias("offset")).drop("position")
        out = part if out is None else out.unionByName(part)
    return out


def microbatches(rows: DataFrame, position: str, ranks: int, micro: int, per_device: int) -> DataFrame:
    """Where each draw stands: step, microbatch, rank, row. The ids of a step do not depend on the topology."""
    whole = ranks * micro * per_device
    at = F.col(position) % whole
    return rows.select(
        "*",
        F.floor(F.col(position) / whole).alias("step"),
        F.floor(at / (ranks * per_device)).alias("microbatch"),
        F.floor((at % (ranks * per_device)) / per_device).alias("rank"),
        (at % per_device).alias("row"),
    )


def text_split(rows: DataFrame, text: str, fraction: float, seed: str) -> DataFrame:
    """Distinct texts go to dev as a whole: min(n - 1, max(1, half-even round of n * fraction)) of them."""
    distinct = permutation(rows.select(text).distinct(), text, seed)
    n = distinct.agg(F.count("*").alias("__n"))
    dev = F.least(F.col("__n") - 1, F.greatest(F.lit(1), F.bround(F.col("__n") * fraction)))
    placed = distinct.crossJoin(F.broadcast(n)).select(text, F.when(F.col("position") < dev, "dev").otherwise("train").alias("split"))  # one row
    return rows.join(placed, text)


def speed_assignments(rows: DataFrame, row_id: str, seed: str) -> DataFrame:
    """Permuted place modulo 3 to 0.9, 1.0, 1.1."""
    return permutation(rows, row_id, seed).withColumn("speed", F.element_at(F.array(F.lit(0.9), F.lit(1.0), F.lit(1.1)), (F.col("position") % 3 + 1).cast("int"))).drop("position")


def spread_batches(official: DataFrame, other: DataFrame, batch: str) -> DataFrame:
    """Merges two numbered series of batches (0, 1, 2, ... in column `batch`) so that official ones are spread evenly.

    After k batches at least ceil(k * official / total) are official: the j-th official one stands at the first
    place k with j * total <= k * official, the others fill the places left. Adds place and kind.
    """
    counts = official.agg(F.count("*").alias("__o")).crossJoin(other.agg(F.count("*").alias("__e")))  # one row
    n, m, j = F.col("__o"), F.col("__e"), F.col(batch)
    # the first place k with j * (n + m) <= k * n; of the others the j-th stands behind all official ones due before it
    first = official.crossJoin(F.broadcast(counts)).select(*official.columns, F.expr(f"cast({batch} * (__o + __e) + __o - 1 as bigint) div __o").alias("place"), F.lit("official").alias("kind"))
    rest = other.crossJoin(F.broadcast(counts)).select(*other.columns, (j + F.when(n > 0, F.expr(f"(cast({batch} as bigint) * __o) div greatest(__e, 1)") + 1).otherwise(F.lit(0))).alias("place"), F.lit("other").alias("kind"))
    return first.unionByName(rest)


def repair_duplicates(ids: list, size: int, groups: dict | None = None) -> list:
    """No batch of `size` holds an id twice. A draw that its batch already holds changes places with the first draw
    of a later batch whose id the batch lacks and, with groups (id to group), whose group is the same; fatal if none.

    Over the draws of a few steps, as a list."""
    out = list(ids)
    for place in range(len(out)):
        start = place - place % size
        if out[place] not in out[start:place]:
            continue
        rest = {*out[start:place], *out[place + 1 : start + size]}
        wanted = groups and groups[out[place]]
        free = (k for k in range(start + size, len(out)) if out[k] not in rest and (groups is None or groups[out[k]] == wanted))
        other = next(free, None)
        if other is None:
            raise ValueError("a batch can't be freed of duplicates")
        out[place], out[other] = out[other], out[place]
    return out


def balanced_order(rows: DataFrame, bucket: str, within: Iterable[str | Column], counts: DataFrame, reference: str) -> DataFrame:
    """Rows of each bucket in order, merged by (place / reference count, bucket). counts: bucket and reference count."""
    order = Window.partitionBy(bucket).orderBy(*within)
    placed = rows.withColumn("place", F.row_number().over(order)).join(counts.where(F.col(reference) > 0), bucket)
    return placed.withColumn("priority", F.col("place") / F.col(reference))


def tail_after_prefix(rows: DataFrame, index: str, size: int) -> DataFrame:
    """What follows the first `size` rows."""
    return rows.where(F.col(index) >= size)


def source_balanced(rows: DataFrame, source: str, row_id: str, draws: int, epoch: int, seed: str) -> DataFrame:
    """M13, source-balanced policies: `draws` of each source, each row once where the pool suffices, else repeated. Adds draw."""
    names = [r[source] for r in rows.select(source).distinct().limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("too many sources")
    sizes = {r[source]: r["n"] for r in rows.groupBy(source).agg(F.count("*").alias("n")).collect()}
    out = None
    for name in sorted(names):
        pool = rows.where(F.col(source) == name)
        part = (cyclic_sample if sizes[name] >= draws else repeated_sample)(pool, row_id, draws, epoch, seed, name)
        out = part if out is None else out.unionByName(part)
    return out


def blocks_with_one(main: DataFrame, other: DataFrame, row_id: str, block: int, blocks: int, epoch: int, seed: str) -> DataFrame:
    """M13, 80/20 policy: blocks of `block` draws with one draw of `other` at a place that a digest picks. Adds draw and pool."""
    place = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col("b")), 256), 1, 8), 16, 10).cast("long"), F.lit(block))
    one = repeated_sample(other, row_id, blocks, epoch, seed, "other").withColumn("b", F.col("draw"))
    one = one.withColumn("draw", F.col("b") * block + place).withColumn("pool", F.lit("other"))
    rest = repeated_sample(main, row_id, blocks * (block - 1), epoch, seed, "main").withColumn("b", F.floor(F.col("draw") / (block - 1)))
    slot = F.col("draw") % (block - 1)
    rest = rest.withColumn("draw", F.col("b") * block + slot + (slot >= place).cast("long")).withColumn("pool", F.lit("main"))
    return one.unionByName(rest).drop("b")
