"""Readers: parquet tables, folders of files, delimited text and office documents."""
