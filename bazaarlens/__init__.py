"""Marketplace listing analytics as ordinary Spark jobs.

Subpackages
-----------
sources    schemas, scans, derived test tables, exports, versioned table upkeep
functions  column expressions (text, scoring, images, errors, bands)
operators  reusable relational building blocks (filters, joins, windows, folds)
plans      reports, views, rule sets, ingest and the fluent listing query
streaming  windowed and stateful queries over request, error and page streams
"""

__version__ = "0.1.0"
