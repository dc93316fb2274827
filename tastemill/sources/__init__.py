"""Readers and writers: package folders, tables, JDBC, stand-in views."""
