"""Operators: DataFrame in, DataFrame out, keyed by symbol, chain or episode."""
