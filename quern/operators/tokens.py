"""Token sequences: cycles at the end, runaway detection, truncation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import reasons


def drop_special(ids: Column, special: list[int]) -> Column:
    """Order and repeats stay."""
    return F.filter(ids, lambda x: ~x.isin(*special)) if special else ids


def until_end(ids: Column, end: int, first: int = 0) -> Column:
    """Through the first end id at or after place `first` (0 or 1); all ids if there is none."""
    place = F.array_position(F.slice(ids, first + 1, F.greatest(F.size(ids) - first, F.lit(0))), end)
    return F.when(place > 0, F.slice(ids, 1, (place + first).cast("int"))).otherwise(ids)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def end_repeats(ids: Column, widest: int) -> Column:
    """For each width from 1 to `widest` the copies of the last `width` ids that stand at the end, one behind the other."""
    size = F.size(ids)

    def repeats(last: Column, width: int) -> Column:
        # the ids from the end on that equal the id `width` places before them
        alike = F.zip_with(F.slice(last, F.lit(1), size - width), F.slice(last, F.lit(width + 1), size - width), lambda x, y: x.eqNullSafe(y))
        other = F.array_position(alike, False)
        run = F.when(other > 0, other - 1).otherwise(size - width)
        return F.when(size < width, F.lit(0)).when((size == width) | ~F.get(last, F.lit(0)).eqNullSafe(F.get(last, F.lit(width))), F.lit(1)).otherwise((F.floor(run / width) + 1).cast("int"))

    return _once(F.reverse(ids), lambda last: F.array(*(repeats(last, w) for w in range(1, widest + 1))))


def trailing_period(ids: Column, widest: int = 8, found: Column | None = None) -> Column:
    """Struct size, repeats, coverage of the best end cycle by (coverage, repeats, -size) with at least two repeats, or null.

    found, here and below: end_repeats of these ids with at least the widths asked for, where it is at hand.
    """
    found = end_repeats(ids, widest) if found is None else F.slice(found, 1, widest)
    cycles = F.transform(found, lambda n, i: F.when(n >= 2, F.struct((n * (i + 1)).alias("coverage"), n.alias("repeats"), (-i - 1).alias("minus"))))
    return _once(F.array_max(cycles), lambda best: F.when(best.isNotNull(), F.struct((-best["minus"]).alias("size"), best["repeats"].alias("repeats"), best["coverage"].alias("coverage"))))


def trailing_cycle(ids: Column, found: Column | None = None) -> Column:
    """C11: width (1 to 4) of an end cycle with at least four repeats over at least eight ids, or null; the narrowest."""

    def narrowest(n: Column) -> Column:
        case = F.when(F.get(n, F.lit(0)) >= 8, F.lit(1))
        for w in (2, 3, 4):
            case = case.when(F.get(n, F.lit(w - 1)) >= 4, F.lit(w))
        return case

    return narrowest(found) if found is not None else _once(end_repeats(ids, 4), narrowest)


def runaway_reasons(ids: Column, reached_max: Column, found: Column | None = None) -> Column:
    """C9 over content ids: nothing below 64 ids; an end cycle of 4 repeats over 24 ids, fewer than a quarter distinct ids in the last 64, or at the length limit 3 repeats over 18."""
    if found is None:
        return _once(end_repeats(ids, 16), lambda n: runaway_reasons(ids, reached_max, n))
    tail = F.slice(ids, -64, 64)

    def rules(cycles: Column) -> Column:
        near, far = cycles["near"], cycles["far"]
        return reasons(
            (
                (F.coalesce((near["repeats"] >= 4) & (near["coverage"] >= 24), F.lit(False)), "trailing_ngram_cycle"),
                (F.size(F.array_distinct(tail)) / 64 < 0.25, "low_tail_token_diversity"),
                (reached_max & F.coalesce((far["repeats"] >= 3) & (far["coverage"] >= 18), F.lit(False)), "max_length_periodic_cycle"),
            )
        )

    cycles = F.struct(trailing_period(ids, 8, found).alias("near"), trailing_period(ids, 16, found).alias("far"))
    return F.when(F.size(ids) < 64, F.array().cast("array<string>")).otherwise(_once(cycles, rules))


def recovery_reasons(text_reasons: Column, candidate: Column, content: Column, end: int, reached_max: Column) -> Column:
    """Why a recovered candidate is refused, each reason once, in order; accepted if none."""
    more = reasons(((~F.array_contains(candidate, end), "missing_eos"), (F.size(runaway_reasons(content, reached_max)) > 0, "runaway_persists"), (F.size(content) < 4, "obvious_abnormal_truncation")))
    return F.array_distinct(F.concat(text_reasons, more))
