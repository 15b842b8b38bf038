"""Claim verification and fact management as Spark DataFrame operators."""
