"""Step-function binning rules (B1-B5) as data, compiled to CASE WHEN.

Each rule is a list of ``(upper_bound, inclusive, label)`` checked in order,
plus the label for values above the last bound. The expression is a plain
``F.when`` chain, so it stays inside whole-stage codegen (no Python UDF).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RuleBins:
    source: str
    steps: tuple  # ((upper, inclusive, label), ...)
    otherwise: str

    def expr(self, col: Column | str | None = None) -> Column:
        c = F.col(col) if isinstance(col, str) else (col if col is not None else F.col(self.source))
        out = None
        for upper, inclusive, label in self.steps:
            cond = (c <= F.lit(float(upper))) if inclusive else (c < F.lit(float(upper)))
            out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
        return out.otherwise(F.lit(self.otherwise))

    def sql(self, col: str | None = None) -> str:
        c = col or self.source
        parts = [f"WHEN {c} {'<=' if inc else '<'} {float(up)!r} THEN '{lab}'"
                 for up, inc, lab in self.steps]
        return "CASE " + " ".join(parts) + f" ELSE '{self.otherwise}' END"

    @property
    def labels(self) -> list[str]:
        return [s[2] for s in self.steps] + [self.otherwise]


# ---------------------------------------------------------------------------
# Bin bounds and labels that must equal the reference's output
# (upper bound, bound is inclusive, label), in the reference's order.
# ---------------------------------------------------------------------------
COMPLETED_TRIP = RuleBins("completed_trip", (
    (7, True, "0 - 7"),
    (14, True, "7 - 14"),
    (28, True, "14 - 28"),
    (50, True, "28 - 50"),
    (100, True, "50 - 100"),
), ">100")

TOTAL_FARE = RuleBins("total_fare", (
    (100000, True, "< 100k"),
    (1000000, True, "100k - 1 mil"),
    (5000000, True, "1 - 5 mil"),
), "> 5 mil")

TOTAL_ETA = RuleBins("total_ETA", (
    (1, True, "< 1 min"),
    (60, True, "1 - 60 mins"),
    (480, True, "60 - 480 mins"),
), "> 480")

DISTANCE_TRAVELLED = RuleBins("distance_travelled", (
    (1, False, "< 1 km"),
    (10, True, "1 - 10km"),
    (50, True, "10 - 50km"),
    (100, True, "50 - 100km"),
    (1000, True, "100 - 1000km"),
), "> 1000km")

SEGMENT = RuleBins("sum_sh", (
    (10, False, "Part-time"),
    (20, False, "Low-medium"),
    (40, False, "Medium"),
    (60, False, "Full-time"),
), "High Full-time")

# Fill values of the reference (fixed): missing model name and missing segment.
VEHICLE_MODEL_FILL = "None"
SEGMENT_FILL = "Parttime"

# Output column per rule: ``<measure>_discrete`` for measures, ``segment`` for B5.
RULES = {
    "completed_trip_discrete": COMPLETED_TRIP,
    "total_fare_discrete": TOTAL_FARE,
    "total_ETA_discrete": TOTAL_ETA,
    "distance_travelled_discrete": DISTANCE_TRAVELLED,
    "segment": SEGMENT,
}
