"""Bond (minimal multiway edge cut) analytics as plain Spark DataFrames."""
