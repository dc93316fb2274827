"""Registered queries with their SQL counterparts, and the batch workflows."""
