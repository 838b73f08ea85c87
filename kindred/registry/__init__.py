"""Registered queries: an operator on the given tables plus an independent SQL oracle."""
