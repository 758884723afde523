"""Land-record integration on Spark: sources, matching, golden records, checks and feeds."""
