"""colloquy: a Spark-native engine for corpora of multi-speaker transcripts.

Everything is a function from DataFrames (or Columns) to DataFrames (or
Columns); nothing runs until the caller asks for rows.
"""

__version__ = "0.1.0"
