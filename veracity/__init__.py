"""veracity: reliability analytics and corpus preparation on PySpark."""
