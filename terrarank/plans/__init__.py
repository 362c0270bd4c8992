"""Registered queries: every operator bound to the test tables, with the SQL that must agree."""
