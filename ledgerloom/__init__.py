"""Ledger document analytics as Spark DataFrame jobs."""
