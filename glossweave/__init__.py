"""glossweave: lexicon text analytics and word-similarity search on Spark.

Every public function takes and returns DataFrames (or Columns), so a caller
composes them into one plan and leaves the physical strategy to Catalyst.
"""

__version__ = "0.1.0"
