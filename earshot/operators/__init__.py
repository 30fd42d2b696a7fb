"""DataFrame-to-DataFrame operators, independent of any particular table."""
