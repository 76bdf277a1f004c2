from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the savings comparison: the baseline is the 30 dates from day -60 to day -31,
# the current window starts at day -30.  They do not follow ``Params.lookback``.
BASELINE_FROM = 60
BASELINE_TO = 31
CURRENT_FROM = 30
BASELINE_DAYS = 30

# The shortest and longest lookback of the reports; the history view shows no more.
MIN_LOOKBACK, MAX_LOOKBACK = 7, 90

# Fixed value: list price of one billing unit in USD.
DEFAULT_RATE = 0.70


@dataclass(frozen=True)
class Params:
    """Report parameters. Dates are literals, so plans are reproducible and prune partitions."""

    as_of: date
    lookback: int = 30
    rate: float = DEFAULT_RATE
    exact_counts: bool = False

    def __post_init__(self) -> None:
        if not MIN_LOOKBACK <= self.lookback <= MAX_LOOKBACK:
            raise ValueError(f"lookback must be {MIN_LOOKBACK} to {MAX_LOOKBACK} days, not {self.lookback}")

    def ago(self, days: int) -> date:
        return self.as_of - timedelta(days=days)

    def day(self, days: int) -> Column:
        return F.lit(self.ago(days))

    @property
    def since(self) -> Column:
        return self.day(self.lookback)

    @property
    def window(self) -> str:
        """Label of the current window, ``yyyy-MM-dd/yyyy-MM-dd``."""
        return f"{self.ago(CURRENT_FROM).isoformat()}/{self.as_of.isoformat()}"
