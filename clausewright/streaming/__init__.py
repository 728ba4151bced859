"""Streams: files to clauses, log windows, job states."""
