"""Crawled web pages to tables, records and Markdown documents on Spark."""
