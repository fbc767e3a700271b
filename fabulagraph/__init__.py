"""A Spark engine for narrative graphs and persona analytics."""
