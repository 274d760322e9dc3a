"""lectern: quality control of recorded narration, and of any ordered, segmented data, on Spark DataFrames."""

__version__ = "0.1.0"
