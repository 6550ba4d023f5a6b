"""Column builders: text, numerals, legal metadata, dates, model output."""
