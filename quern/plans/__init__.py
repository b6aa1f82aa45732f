"""Query registries: each module has QUERIES (name to callable) and ORACLE (name to SQL)."""
