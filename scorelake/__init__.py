"""scorelake: table operators over corpora of scanned sheet music, on Spark DataFrames."""

__version__ = "0.1.0"
