"""The registered queries: each operator over its whole table."""
