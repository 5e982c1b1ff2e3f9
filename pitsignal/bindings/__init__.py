"""Binding of the operators to the driver tables, with a SQL oracle for each query."""
