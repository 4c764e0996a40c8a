"""Table schemas, readers, writers and input contracts."""
