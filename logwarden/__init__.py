"""Spark-native analytics for service logs: templates, anomalies, incidents, remediation."""
