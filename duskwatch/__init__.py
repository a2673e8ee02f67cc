"""Security-log analytics as Spark jobs: network, host and run-audit records."""
