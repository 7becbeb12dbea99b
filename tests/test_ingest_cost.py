"""What the ingest jobs compute more than once."""

from checks.source_checks import _merged
from checks.tables import Tables


def test_merge_parses_pages_once(spark):
    merged = _merged(Tables(spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" not in merged._jdf.queryExecution().executedPlan().toString()
