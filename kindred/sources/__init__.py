"""Readers for the text formats and writers for tables.

Every reader is ``parse_*`` on a DataFrame with a ``value`` column of lines plus a thin
``read_*`` that supplies the lines, so the parsing is a Spark projection that works on any
line source.
"""
