"""lakeweave: contract-driven data integration and analytics on PySpark."""

__version__ = "0.1.0"
