"""Continuous operation: periodic cycles, following growing files, keyed state, listeners."""
