"""The most frequent rows of a table of counts, found without sorting or merging it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the cutoff for each doubling of a count, and parts of a step that does not fit as a whole.
STEPS, PARTS = 16, 1024


def _fitting(groups: list[tuple[int, int]], room: int) -> tuple[int | None, int]:
    """Of (name, rows), in the order to take them: the last that fits, and the room that is left."""
    last = None
    for name, n in groups:
        if n > room:
            break
        last, room = name, room - n
    return last, room


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of counts with the largest n, at most ``most`` of them.

    Counts are put into steps of a sixteenth of a doubling, at most some thousand of them; whole steps are taken from
    the top while they fit, and of the next one as many parts, dealt by a hash of the row, as still do. So the rows
    come from a filter, and there are fewer than ``most`` by at most such a part.
    """
    some = counts.where(F.col(n) > 0)
    step = F.floor(F.log2(F.col(n).cast("double")) * STEPS).cast("int")
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in counts.columns)), F.lit(PARTS)).cast("int")
    sized = lambda df, by: sorted((r["g"], r["k"]) for r in df.groupBy(by.alias("g")).agg(F.count("*").alias("k")).collect())
    steps = sized(some, step)[::-1]
    cutoff, room = _fitting(steps, most)
    taken: Column = F.lit(False) if cutoff is None else step >= cutoff
    following = next((s for s, _ in steps if cutoff is None or s < cutoff), None)
    if following is not None and room:
        last, _ = _fitting(sized(some.where(step == following), part), room)
        if last is not None:
            taken = taken | ((step == following) & (part <= last))
    return some.where(taken)
