"""lakemill: a Spark-native analytics engine for review-style fact data."""
