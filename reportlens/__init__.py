"""Group, check and explain large collections of narrative reports on Spark."""
