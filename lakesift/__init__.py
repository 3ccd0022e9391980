"""lakesift: sensitive-data analytics and table maintenance on PySpark."""
