"""hushframe: private context is detected, rewritten and verified in text, at table scale, as Spark DataFrames."""

__version__ = "0.1.0"
