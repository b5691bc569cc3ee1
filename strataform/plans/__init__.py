"""Queries put together from the operators, with the SQL they are held against."""
