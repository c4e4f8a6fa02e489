"""The registered queries: the package's operators over the given tables."""
