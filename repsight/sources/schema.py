"""Declared schemas of the six star-schema tables (no schema inference)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()
_MONEY, _RATE = T.DecimalType(18, 2), T.DecimalType(5, 3)


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


TERRITORIES = _st(("territory_id", _S), ("region", _S), ("state", _S), ("market_potential_index", _D),
                  ("urban_index", _D), ("competitor_intensity", _D), ("num_target_hcps", _L),
                  ("population_000s", _L))
PRODUCTS = _st(("product_id", _S), ("name", _S), ("therapeutic_area", _S), ("launch_year", _I),
               ("list_price", _L), ("market_share_pct", _D), ("market_growth_rate", _D),
               ("bcg_quadrant", _S))
REPS = _st(("rep_id", _S), ("rep_name", _S), ("territory_id", _S), ("region", _S),
           ("experience_years", _I), ("hire_date", T.DateType()), ("education", _S),
           ("productivity_score", _D))
PHYSICIANS = _st(("hcp_id", _S), ("hcp_name", _S), ("territory_id", _S), ("specialty", _S),
                 ("prescriber_tier", _S), ("monthly_rx_volume", _L), ("years_in_practice", _L),
                 ("hospital_affiliation", _S), ("digital_engagement", _S))
SALES = _st(("sale_id", _S), ("rep_id", _S), ("territory_id", _S), ("product_id", _S),
            ("month", T.DateType()), ("year", _I), ("month_num", _I), ("units_sold", _L),
            ("revenue_usd", _MONEY), ("discount_pct", _RATE), ("net_revenue_usd", _MONEY))
CALL_LOGS = _st(("call_id", _S), ("rep_id", _S), ("hcp_id", _S), ("territory_id", _S),
                ("product_promoted", _S), ("call_date", T.DateType()), ("month", T.DateType()),
                ("year", _I), ("month_num", _I), ("channel", _S), ("call_outcome", _S),
                ("converted", T.BooleanType()), ("call_duration_min", _L),
                ("samples_dropped", T.BooleanType()))

SCHEMAS: dict[str, T.StructType] = {
    "territories": TERRITORIES, "products": PRODUCTS, "reps": REPS,
    "physicians": PHYSICIANS, "sales": SALES, "call_logs": CALL_LOGS,
}


@dataclass(frozen=True)
class Star:
    """The six tables every operator reads from."""
    territories: DataFrame
    products: DataFrame
    reps: DataFrame
    physicians: DataFrame
    sales: DataFrame
    call_logs: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"territories": self.territories, "products": self.products, "reps": self.reps,
                "physicians": self.physicians, "sales": self.sales, "call_logs": self.call_logs}
