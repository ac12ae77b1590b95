"""All queries on the reference operators."""

from docweave.plans import file_queries, scan_queries, structure_queries, text_queries, vendor_queries  # noqa: F401
from docweave.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
