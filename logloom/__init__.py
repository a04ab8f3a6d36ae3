"""logloom: log-template mining and scoring as Spark DataFrame jobs.

Lines are masked, tokenized, keyed by their vocabulary ("static") tokens,
grouped, turned into templates, merged, matched and scored against ground
truth.  Every step is a DataFrame -> DataFrame job; see README.md.
"""

__version__ = "0.1.0"
