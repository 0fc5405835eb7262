"""Query registry (one module per operator group) and the DuckDB oracle statements."""
