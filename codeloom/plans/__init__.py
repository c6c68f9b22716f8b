"""Named plans: each registered query is (spark, sf_dir) -> DataFrame, with its
DuckDB oracle text beside it."""
