"""Queries that run the operators on whole tables, and the SQL that they are compared with."""
