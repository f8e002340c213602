"""gridcast: short-term load forecasting over many meters, as Spark jobs.

Every operator takes and returns DataFrames in the long form
``(series_id, ts, load, <covariate>...)``; ``ts`` is a ``TIMESTAMP_NTZ`` wall
clock time and a missing reading is NULL.
"""

from gridcast.session import get_session

__all__ = ["get_session"]
__version__ = "0.1.0"
