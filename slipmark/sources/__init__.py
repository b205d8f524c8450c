"""Readers and writers of problem sets, response logs, task maps and summaries."""
