"""Imports every module that registers queries."""

from workload import dependencies, feeds, reporting, scanning, timing  # noqa: F401
from workload.base import QUERIES, SQL  # noqa: F401
