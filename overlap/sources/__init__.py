"""Sources and sinks: Parquet scans, the TPC-H-derived fixture tables, writers."""

from overlap.sources.fixtures import exploded_locations, interests, locations, people
from overlap.sources.sinks import (
    count_rows, drop_table, read_bucket, read_partitioned, write_bucketed_table,
    write_parquet, write_partitioned, write_report_csv,
)
from overlap.sources.tables import read_table

__all__ = [
    "read_table", "interests", "locations", "exploded_locations", "people",
    "write_parquet", "write_partitioned", "write_bucketed_table", "drop_table",
    "write_report_csv", "read_bucket", "read_partitioned", "count_rows",
]
