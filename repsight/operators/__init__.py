"""The analysis operators, one module per analysis module of the original."""

from repsight.operators import (coverage, effectiveness, kpi, performance, portfolio, prep, promotion,
                                reports, whitespace)

__all__ = ["coverage", "effectiveness", "kpi", "performance", "portfolio", "prep", "promotion", "reports",
           "whitespace"]
