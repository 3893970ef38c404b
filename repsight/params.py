"""Business constants of the analysis, gathered in one frozen dataclass.

Every operator takes a ``Params``; nothing is hard-coded in the operators.
``Params()`` carries the defaults of the original analysis; ``fixture_params()``
carries the values tuned to the TPC-H-shaped test tables (see FIXTURES.md).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, replace

# Fixed values that must equal the original analysis for equal results.
# Channel cost per interaction, in the order the analysis lists them.
DEFAULT_CHANNEL_COSTS: tuple[tuple[str, int], ...] = (
    ("In-Person Visit", 180),
    ("Virtual Detail", 35),
    ("Conference", 450),
    ("Email Follow-up", 8),
    ("Speaker Program", 280),
)
# The same costs, in the same order, for the channels of the test tables (o_orderpriority).
FIXTURE_CHANNEL_COSTS: tuple[tuple[str, int], ...] = tuple(
    zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), (c for _, c in DEFAULT_CHANNEL_COSTS), strict=True))
# Revenue factor per prescriber tier for the monthly potential; others get ``other_tier_factor``.
DEFAULT_TIER_FACTORS: tuple[tuple[str, float], ...] = (("A", 1.0), ("B", 0.6))
# Call-plan weights per tier (0.5 / 0.3 / 0.2), kept as integers in tenths so sums are exact.
DEFAULT_TIER_WEIGHTS_TENTHS: tuple[tuple[str, int], ...] = (("A", 5), ("B", 3), ("C", 2))


@dataclass(frozen=True)
class Params:
    # analysis window
    prior_year: int = 2023
    current_year: int = 2024
    period_months: int = 24            # fixed period for HCP monthly calls
    first_year: int | None = None      # first year of that period; None: prior_year
    months_per_year: int = 12          # annualisation of monthly potential

    # whitespace
    revenue_per_mpi_point: float = 8500.0

    # coverage gap thresholds (calls per month)
    tier_a_critical: float = 1.0
    tier_a_under: float = 2.0
    tier_b_under: float = 0.5
    revenue_per_rx: float = 420.0
    tier_factors: tuple[tuple[str, float], ...] = DEFAULT_TIER_FACTORS
    other_tier_factor: float = 0.3

    # promotion
    channel_costs: tuple[tuple[str, int], ...] = DEFAULT_CHANNEL_COSTS
    # channel rates: unweighted mean of channel x product x territory cells (the published
    # rule) or, when True, conversions over interactions
    weighted_channel_rates: bool = False

    # tiles
    revenue_tiles: int = 5             # territory quintiles
    rep_tiles: int = 4                 # rep quartiles

    # product portfolio (BCG) cut-offs
    bcg_share_cut: float = 0.15
    bcg_growth_cut: float = 0.10

    # findings
    high_potential_mpi: float = 70.0
    low_realization_pct: float = 30.0
    mandate_rx: int = 50
    mandate_visits: float = 1.0
    mandate_tier: str = "A"            # the finding's second list: this tier, visited less than that

    # deployment segments (MPI / 100 against productivity score)
    under_mpi: float = 0.7
    under_productivity: float = 0.5
    over_mpi: float = 0.4
    over_productivity: float = 0.7

    # first-match rules as data, in order: (label, ((value, test, limit), ...)); None: the rules
    # of the thresholds above. Values: tier, monthly_calls, calls; potential, productivity
    coverage_rules: tuple[tuple[str, tuple[tuple[str, str, object], ...]], ...] | None = None
    deployment_rules: tuple[tuple[str, tuple[tuple[str, str, object], ...]], ...] | None = None

    # call plan weights
    tier_weights_tenths: tuple[tuple[str, int], ...] = DEFAULT_TIER_WEIGHTS_TENTHS

    # report scope
    top_n: int = 5

    # COUNT(DISTINCT ..): exact when None; else HyperLogLog++ with this relative standard
    # deviation (no Expand, no extra shuffle of the distinct values)
    approx_distinct_rsd: float | None = None
    # distinct months per rep or HCP as bits of so many longs (64 months each, the span of one
    # group's dates); 0: COUNT(DISTINCT ..), any span
    month_words: int = 2

    def __post_init__(self) -> None:
        problems = []
        if self.prior_year >= self.current_year:
            problems.append("prior_year must be before current_year")
        if self.period_months < 1 or self.months_per_year < 1:
            problems.append("period_months and months_per_year must be positive")
        if self.month_words < 0:
            problems.append("month_words must be >= 0")
        if min(self.revenue_tiles, self.rep_tiles, self.top_n) < 1:
            problems.append("tile counts and top_n must be positive")
        if not self.tier_a_critical <= self.tier_a_under:
            problems.append("tier_a_critical must not exceed tier_a_under")
        if any(w < 0 for _, w in self.tier_weights_tenths):
            problems.append("call-plan weights must be >= 0")
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def coverage_table(self) -> tuple:
        """The coverage rules of #17 in order."""
        if self.coverage_rules is not None:
            return self.coverage_rules
        return (
            ("Critical Gap", (("tier", "=", "A"), ("monthly_calls", "<", self.tier_a_critical))),
            ("Undercovered", (("tier", "=", "A"), ("monthly_calls", "<", self.tier_a_under))),
            ("Undercovered", (("tier", "=", "B"), ("monthly_calls", "<", self.tier_b_under))),
            ("Not Reached", (("calls", "=", 0),)),
            ("Adequately Covered", ()),
        )

    @property
    def deployment_table(self) -> tuple:
        """The deployment rules of #47 in order."""
        if self.deployment_rules is not None:
            return self.deployment_rules
        return (
            ("Underperforming", (("potential", ">", self.under_mpi), ("productivity", "<", self.under_productivity))),
            ("Oversaturated", (("potential", "<", self.over_mpi), ("productivity", ">", self.over_productivity))),
            ("Normal", ()),
        )

    @property
    def period_start(self) -> _dt.date:
        return _dt.date(self.first_year or self.prior_year, 1, 1)

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)


def fixture_params() -> Params:
    """Parameters for the TPC-H-shaped test tables (FIXTURES.md §3)."""
    return Params(
        prior_year=1999,
        current_year=2000,
        first_year=1995,
        period_months=84,
        revenue_per_mpi_point=400_000.0,
        tier_a_critical=0.35,
        tier_a_under=0.5,
        tier_b_under=0.3,
        bcg_share_cut=1 / 6,
        bcg_growth_cut=0.2555,
        channel_costs=FIXTURE_CHANNEL_COSTS,
        mandate_rx=50,
        mandate_visits=0.45,
    )
