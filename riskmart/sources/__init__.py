"""Raw file readers, partitioned tables and shared working folders."""

from riskmart.sources.raw import read_raw
from riskmart.sources.tables import (
    overwrite_snapshots,
    overwrite_table,
    read_merged,
    read_range,
    read_snapshot,
    read_table,
    table_exists,
)
from riskmart.sources.workspace import ensure_checkpoint_dir, remove_folder, working_folder

__all__ = [
    "ensure_checkpoint_dir",
    "overwrite_snapshots",
    "overwrite_table",
    "read_merged",
    "read_range",
    "read_raw",
    "read_snapshot",
    "read_table",
    "remove_folder",
    "table_exists",
    "working_folder",
]
