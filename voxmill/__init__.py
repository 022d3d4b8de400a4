"""Voxmill: user-feedback analytics as plain Spark DataFrame functions.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
and nothing runs until the caller asks for an action.  The same column
functions serve batch and Structured Streaming.
"""
