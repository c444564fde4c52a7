"""Location-aware price comparison on Spark."""
