"""Registered queries: each binds an operator to the test tables and states its SQL check."""
