"""Table operators for market, filing and document data on Spark."""
