"""pkgpulse: Spark-native analytics over package-download request logs.

Ingest jobs turn raw request snapshots into curated Parquet tables; report
builders turn curated tables into DataFrames (trailing-window totals, top and
trending packages, daily shares by region / language version / system,
per-package summaries). Everything is a lazy DataFrame plan; nothing is
collected in library code.
"""

__version__ = "0.1.0"
