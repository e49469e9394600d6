"""Table sources: schemas, the production Parquet layout, and the test-data mapping."""

from .fixture import fixture_tables
from .layout import read_business_tables, write_business_tables
from .quality import Quality
from .reports import read_reports, write_reports
from .schema import SCHEMAS, check_schema
from .states import read_states, refresh_states
from .tables import TABLE_NAMES, Tables, read_parquet_tables
from .validate import check_unique_keys, duplicate_keys, require_unique

__all__ = [
    "Quality",
    "SCHEMAS",
    "TABLE_NAMES",
    "Tables",
    "check_schema",
    "check_unique_keys",
    "duplicate_keys",
    "fixture_tables",
    "read_business_tables",
    "read_reports",
    "read_states",
    "refresh_states",
    "read_parquet_tables",
    "require_unique",
    "write_business_tables",
    "write_reports",
]
