"""Order keys, unbounded instants and strategies for choosing the patch of a measurement run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The total order of patches: time (rank -1: the beginning of time, 0: finite, 1: the end), then the revision that
#: introduced the current version, the place in its booking, the place in its event.
ORDER = ("when_rank", "when_ts", "revision", "tb", "intra")


def order_key(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ORDER])


def ordered(descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in ORDER]


def at_or_before(rank: Column, ts: Column, when, inclusive: bool = True) -> Column:
    """(rank, ts) <= when (or <), `when` being a timestamp, "-inf" or "+inf"."""
    if when == "+inf":
        return rank <= 1 if inclusive else rank < 1
    if when == "-inf":
        return rank == -1 if inclusive else F.lit(False)
    w = F.lit(when).cast("timestamp_ntz")
    finite = ts <= w if inclusive else ts < w
    return (rank < 0) | ((rank == 0) & finite)


#: Which patch of a run is applied at the run's anchor: aggregates of (value, key). The reference rule is `latest`.
BEST_PATCH = {
    "latest": lambda value, key: F.max_by(value, key),
    "earliest": lambda value, key: F.min_by(value, key),
    "largest": lambda value, key: F.max(value),
    "mean": lambda value, key: F.avg(value),
}
