"""Outreach-style event analytics as DataFrame-to-DataFrame transforms on Spark."""
