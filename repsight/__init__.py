"""repsight — sales-force-effectiveness and territory analytics on Spark DataFrames.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
built-in Spark expressions (no Python UDFs), parameterised by ``Params``.
"""

from repsight.params import Params, fixture_params

__all__ = ["Params", "fixture_params"]
