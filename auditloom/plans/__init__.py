"""Query registry: bridges from the driver tables, Spark queries and their SQL twins."""
