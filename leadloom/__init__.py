"""leadloom: hiring-signal analytics and data preparation on PySpark."""
