"""Named analytical queries and their SQL twins."""
