"""Gap filling for spatio-temporal tables, on Spark."""
