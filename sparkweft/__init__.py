"""A typed query engine on PySpark: declared tables, a checked builder, Catalyst plans."""
