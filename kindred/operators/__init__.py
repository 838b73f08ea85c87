"""DataFrame operators by topic; each takes and returns DataFrames and never collects."""
