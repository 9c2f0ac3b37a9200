"""Change-risk analytics on Spark: a change history is a table, and every stage of its review a DataFrame operator."""
