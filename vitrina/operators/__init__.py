"""Batch operators: catalogue, orders, sales, table changes, accounts, checks."""
