"""The row-local parts of a contract over arriving files."""
