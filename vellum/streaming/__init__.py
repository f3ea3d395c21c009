"""Streams over the state operators (an extension: the pipeline itself is batch)."""
