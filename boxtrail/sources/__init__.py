"""Readers and writers at the JSON edge; parquet is the working format."""
