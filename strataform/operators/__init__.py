"""Operators: DataFrame to DataFrame, keyed by cloud or pair, so one plan does all scans together."""
