"""driftline: cascade analytics over graphs and tables, written for Spark."""
