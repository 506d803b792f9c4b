"""Evidence-audit analytics on Spark: DataFrame and Column functions, no engine layer of its own."""
