"""Prose-integrity analytics over large document collections, as Spark DataFrame transformations."""
