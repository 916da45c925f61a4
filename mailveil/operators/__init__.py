"""DataFrame operators: joins, grouping, windows."""
