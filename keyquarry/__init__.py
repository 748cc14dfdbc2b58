"""Credential hygiene and API-usage analytics as Spark DataFrame operators."""
