"""Readers for delimited text, JSON and workbooks, and the sinks."""
