"""Operators over facts, messages, attachments and the access log: DataFrames in, DataFrames out."""
