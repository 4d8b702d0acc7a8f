from shelfmark.sinks.tables import FolderSink, TableSink, Written, materialize, replace_partitions

__all__ = ["FolderSink", "TableSink", "Written", "materialize", "replace_partitions"]
