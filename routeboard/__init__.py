"""routeboard: cross-chain transfer analytics as Spark DataFrame plans.

Layout:

* ``functions``  -- column expressions (typed extraction, rounding, labels, buckets)
* ``sources``    -- raw fact readers, relations derived from the given tables, sinks
* ``operators``  -- normalisation, the sixteen reports, derived tables, exact median
* ``plans``      -- the dashboard suite, the registered query catalog and its oracle
* ``streaming``  -- incremental normalisation of an arriving fact into the base table
"""

from .operators import normalize
from .params import ReportParams

__all__ = ["normalize", "ReportParams"]
