"""Report builders and jobs: curated tables in, DataFrames / tables out."""
