"""textstrata: a PySpark engine for versioned text corpora and training-data work."""
