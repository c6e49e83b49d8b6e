"""Relational operators, one module per workload."""
