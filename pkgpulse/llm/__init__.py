"""Training-data operators: extraction, filtering, de-duplication, scoring, encoding."""
