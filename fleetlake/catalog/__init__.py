"""Registered queries over the driver's tables, each with its SQL oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the library on the given
tables; ``ORACLES[name]`` is the same question as plain SQL for an
independent engine (DuckDB) over the same parquet files. Queries whose answer
is not expressible in SQL register no oracle.
"""

from __future__ import annotations

from fleetlake.catalog.registry import ORACLES, QUERIES

# Importing the modules fills the registry.
from fleetlake.catalog import analytics as _analytics  # noqa: F401,E402
from fleetlake.catalog import listing as _listing  # noqa: F401,E402
from fleetlake.catalog import parsing as _parsing  # noqa: F401,E402
from fleetlake.catalog import identity as _identity  # noqa: F401,E402
from fleetlake.catalog import quality as _quality  # noqa: F401,E402
from fleetlake.catalog import exports as _exports  # noqa: F401,E402
from fleetlake.catalog import stored as _stored  # noqa: F401,E402
from fleetlake.catalog import files as _files  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
