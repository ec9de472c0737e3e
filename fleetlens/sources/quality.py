"""How much of a log could be read, counted while a report runs (OP-05, OP-06, OP-44).

``observe`` puts the counts beside the rows that flow through the parser, so that totals and
malformed lines cost no pass of their own: whichever report reads the parsed lines first fills
them.  Filters above stay above, hence every line counts, also those the report leaves out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: a line is malformed where one of these could not be read
ACCESS_NEEDS = ("ts", "method", "path", "status_code")
ERROR_NEEDS = ("ts",)
WATCHDOG_NEEDS = ("epoch", "type", "message")


class Quality:
    """Counts of one parsed log: lines, malformed lines, and lines without each needed field."""

    def __init__(self, name: str, needs: tuple[str, ...] = ACCESS_NEEDS):
        self.name, self.needs = name, needs
        self.observation = Observation(name)

    def _known(self, field: str) -> Column:
        c = F.col(field)
        return c.isNotNull() & (c.cast("string") != "")

    def watch(self, parsed: DataFrame) -> DataFrame:
        """The same rows, counted as they pass; give it to one report only (the first action that reads it counts)."""
        good = F.lit(True)
        for field in self.needs:
            good = good & self._known(field)
        return parsed.observe(
            self.observation, F.count(F.lit(1)).alias("lines"), F.count_if(~good).alias("malformed"),
            *[F.count_if(~self._known(field)).alias(f"no_{field}") for field in self.needs])

    def figures(self) -> dict[str, int]:
        """The counts; waits for the first action that reads the watched rows."""
        return self.observation.get

    def report(self, spark) -> DataFrame:
        """The counts as one row, with the share of malformed lines."""
        found = self.figures()
        names = ["lines", "malformed", *[f"no_{field}" for field in self.needs]]
        row = spark.createDataFrame([(self.name, *[int(found[n]) for n in names])], "log string, " + ", ".join(f"{n} long" for n in names))
        return row.withColumn("malformed_share", F.try_divide("malformed", "lines"))
