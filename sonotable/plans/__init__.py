"""Jobs and registered queries: fixtures over the driver tables, the query catalog,
its DuckDB statements, the end-to-end annotation job and the model stand-ins."""
