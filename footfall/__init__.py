"""Spark jobs for first-party web analytics and site audits."""
