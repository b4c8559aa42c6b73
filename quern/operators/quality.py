"""Quarantine with reasons, de-duplication and checks that fail closed."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: undecided rows up to which one task settles the rest in order
SETTLE = 20_000


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; where none is set, in a local one, on a local master alone."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quern-"))
    return df.checkpoint()


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Q1, Q9: keys that occur more than once, with their number. Counts are combined before the shuffle."""
    return rows.groupBy(*key).agg(F.count("*").alias("duplicate_count")).where("duplicate_count > 1")


def quarantine_repeated(rows: DataFrame, key: str, reason: str) -> DataFrame:
    """Q1: every member of a repeated key gets the reason; others null."""
    bad = repeated(rows.where(F.col(key).isNotNull()), [key])
    return rows.join(bad, key, "left").withColumn("reason", F.when(F.col("duplicate_count").isNotNull(), reason))


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The first rule that holds, in order of precedence; null if none."""
    case = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        case = F.when(condition, name).otherwise(case)
    return case


def accept_in_order(rows: DataFrame, order: str, keys: list[str], settle: int = SETTLE) -> DataFrame:
    """Q3, Q4, Q6: greedy acceptance. A row is rejected if an accepted earlier row has one of its keys.

    rows: an order column without ties and key columns (null keys never clash). Adds accepted and reason
    (`duplicate_<key>` of the first key in precedence that an accepted earlier row holds). In each round
    a row that is the least undecided one of all its keys is accepted and rows that share a key with an
    accepted row are rejected; a round is one shuffle a key over the undecided rows. Rounds go on until at most
    `settle` rows are undecided (long chains of rows need a round a row), which one task then walks in order.
    """
    open_rows = rows.select(order, *keys)
    held: DataFrame | None = None
    done: DataFrame | None = None
    while True:
        flagged = open_rows
        for k in keys:
            least = open_rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"__{k}"))
            flagged = flagged.join(least, k, "left")
        lead = F.lit(True)
        for k in keys:
            lead = lead & (F.col(k).isNull() | (F.col(f"__{k}") == F.col(order)))
        new = cut(flagged.where(lead).select(order, *keys))
        held = new if held is None else cut(held.unionByName(new))
        rest = open_rows.join(new.select(order), order, "left_anti")
        for k in keys:
            # the least accepted row of a key; later rounds can't accept an earlier one of the same key
            first = held.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"__{k}"))
            rest = rest.join(first, k, "left")
        clash = [(F.col(f"__{k}") < F.col(order), f"duplicate_{k}") for k in keys]
        rest = cut(rest.select(order, *keys, first_reason(clash).alias("reason")))
        out = new.select(order, F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason")).unionByName(
            rest.where("reason is not null").select(order, F.lit(False).alias("accepted"), "reason")
        )
        done = out if done is None else done.unionByName(out)
        open_rows = rest.where("reason is null").select(order, *keys)
        if open_rows.limit(settle + 1).count() <= settle:
            break

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        taken: list[set] = [set() for _ in keys]
        accepted = []
        for row in part.sort_values(order)[list(keys)].itertuples(index=False):
            mine = [(t, v) for t, v in zip(taken, row, strict=True) if v is not None and v == v]
            accepted.append(not any(v in t for t, v in mine))
            if accepted[-1]:
                for t, v in mine:
                    t.add(v)
        return part.sort_values(order).assign(accepted=accepted)

    types = {f.name: f.dataType.simpleString() for f in open_rows.schema.fields}
    walked = cut(open_rows.groupBy(F.lit("rest")).applyInPandas(walk, ", ".join(f"`{n}` {t}" for n, t in types.items()) + ", accepted boolean"))
    held = held.unionByName(walked.where("accepted").select(order, *keys))
    done = done.unionByName(walked.select(order, "accepted", F.lit(None).cast("string").alias("reason")))
    decided = cut(done)
    # a row may share several keys with accepted rows of several rounds: the first key in precedence names the reason
    late = rows.select(order, *keys).join(decided.where("not accepted").select(order), order, "left_semi")
    for k in keys:
        late = late.join(held.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"__{k}")), k, "left")
    why = late.select(order, first_reason([(F.col(f"__{k}") < F.col(order), f"duplicate_{k}") for k in keys]).alias("__why"))
    return rows.join(decided.drop("reason"), order).join(why, order, "left").withColumnRenamed("__why", "reason")


def accept_sources(rows: DataFrame, order: str, row_id: str, payload: str) -> DataFrame:
    """Q2: ids are remembered of every row, payloads of rows that passed all earlier rules alone. Adds reason."""
    first_id = rows.groupBy(row_id).agg(F.min(order).alias("__first"))
    passed = rows.join(first_id, row_id).withColumn("__dup", F.col(order) > F.col("__first"))
    first_payload = passed.where("not __dup").groupBy(payload).agg(F.min(order).alias("__payload"))
    out = passed.join(first_payload, payload, "left")
    return out.withColumn("reason", first_reason([(F.col("__dup"), "duplicate_id"), (F.col("__payload") < F.col(order), "duplicate_payload")])).drop("__first", "__dup", "__payload")


def merge_labels(rows: DataFrame, label: str, evidence: str, order: str, keep: str = "first") -> DataFrame:
    """Q7: one row a label, the first or the last; `conflict` marks labels whose evidence differs (fatal for the caller)."""
    pick = F.min_by if keep == "first" else F.max_by
    others = [c for c in rows.columns if c != label]
    return rows.groupBy(label).agg(pick(F.struct(*others), order).alias("__row"), (F.count_distinct(evidence) > 1).alias("conflict")).select(label, "__row.*", "conflict")


def check(name: str, violations: DataFrame) -> DataFrame:
    """A check, whether it passed, and the number of violating rows."""
    return violations.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), (F.col("violations") == 0).alias("passed"), "violations")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """Q8."""
    return check(f"unique {key}", repeated(rows, [key]))


def one_split_per_name(rows: DataFrame, name: str, split: str) -> DataFrame:
    """Q10: a name in two splits violates."""
    return check(f"{name} in one {split}", rows.groupBy(name).agg(F.count_distinct(split).alias("n")).where("n > 1"))


def require(checks: DataFrame) -> None:
    """Raises with the failed checks."""
    failed = [r.asDict() for r in checks.where("not passed").collect()]  # a row for each check
    if failed:
        raise AssertionError(failed)



