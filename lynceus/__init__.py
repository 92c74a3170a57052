"""Code-security analytics on Spark DataFrames."""

from lynceus.plans.scan import scan
from lynceus.plans.advisory_sync import sync_advisories

__all__ = ["scan", "sync_advisories"]
