"""Whole plans: the build over a directory, the sinks, and the registered queries."""
