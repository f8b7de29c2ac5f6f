"""Keyed running maximum / sum over an ordered event log, safe for hot keys.

Folds over event logs (replay, job lifecycle, closed-event lookup) need, for
every event, "the latest X seen so far for this key". A plain
`Window.partitionBy(key).orderBy(seq)` puts every event of a key into one
task; a key holding a third of the log would then be one task. Instead the log
is cut into (key, seq-bucket) groups of at most `span` consecutive sequence
numbers:

1. inside each (key, bucket) group a window gives the local running max;
2. one aggregate gives each group's total, and a window over those small
   per-group rows gives the carry-in from earlier buckets of the same key;
3. an equi-join on (key, bucket) adds the carry-in back.

Group sizes are bounded by `span` however the keys are distributed, and the
carry table has one row per (key, bucket). `seq` must be a long that orders
the log (e.g. an event id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SPAN = 1 << 12


def running_max(
    df: DataFrame,
    keys: list[str],
    seq: str,
    values: dict[str, Column],
    inclusive: bool = True,
    span: int = DEFAULT_SPAN,
    how: str | dict[str, str] = "max",
) -> DataFrame:
    """Add, per output name in `values`, the max (or sum, `how="sum"`) of that
    expression over the key's events ordered by `seq` up to (inclusive) or
    before (exclusive) the row. Null where no earlier value exists.
    `how` may also map output names to "max" / "sum" to mix both in one pass."""
    fns = {"max": F.max, "sum": F.sum}
    hows = {n: (how.get(n, "max") if isinstance(how, dict) else how) for n in values}
    b = "_scan_bucket"
    tmp = {name: f"_scan_v_{name}" for name in values}
    base = df.withColumn(b, F.floor(F.col(seq) / F.lit(span)).cast("long")).withColumns(
        {tmp[n]: e for n, e in values.items()}
    )
    upper = Window.currentRow if inclusive else -1
    w_local = Window.partitionBy(*keys, b).orderBy(seq).rowsBetween(Window.unboundedPreceding, upper)
    local = base.withColumns({f"_scan_l_{n}": fns[hows[n]](tmp[n]).over(w_local) for n in values})

    # Totals come from the window output, which is already partitioned on
    # (keys, bucket), so both sides of the join below share one exchange (AQE
    # reuses it at run time); the window itself runs on either side.
    totals = local.groupBy(*keys, b).agg(*[fns[hows[n]](tmp[n]).alias(f"_scan_t_{n}") for n in values])
    w_prev = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, b, *[fns[hows[n]](f"_scan_t_{n}").over(w_prev).alias(f"_scan_c_{n}") for n in values]
    )

    out = local.join(carry, [*keys, b], "left")
    def combine(n: str):
        loc, car = F.col(f"_scan_l_{n}"), F.col(f"_scan_c_{n}")
        if hows[n] == "max":
            return F.greatest(loc, car)
        return F.when(loc.isNull() & car.isNull(), F.lit(None)).otherwise(
            F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
        )

    out = out.withColumns({n: combine(n) for n in values})
    drop = [b, *tmp.values(), *[f"_scan_l_{n}" for n in values], *[f"_scan_c_{n}" for n in values]]
    return out.drop(*drop)
