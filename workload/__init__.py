"""The registered queries: the library at work on the driver's tables."""
