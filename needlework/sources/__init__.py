"""Readers and writers: query logs, pattern files, run reports, measurements."""
