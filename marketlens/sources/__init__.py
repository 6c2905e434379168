"""Reading and writing: tables, files, snapshots, query log."""
