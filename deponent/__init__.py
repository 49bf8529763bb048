"""Transcript and text-evidence processing as declarative Spark plans."""
