"""Entry-conditional trade statistics on Spark."""
