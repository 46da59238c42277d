"""Billing-anomaly analytics as Spark DataFrame transformations."""
