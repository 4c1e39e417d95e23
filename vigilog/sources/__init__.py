"""Readers and writers: log files, tables, dimensions."""
