"""chronolith: time-series forecasting analytics expressed as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames.  A panel is a table
with series keys, a zone-free timestamp on a regular step, and value columns;
see :class:`chronolith.operators.grid.Grid`.
"""

import sys

from pyspark import cloudpickle

from chronolith.operators.grid import Grid

# Functions that run inside tasks travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Grid"]
