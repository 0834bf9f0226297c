"""Readers that turn text files into rows, and the parquet/text stores."""
