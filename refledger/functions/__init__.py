"""Column functions: text, dates, numbers, mentions and three-valued logic."""
