"""Phonetic search and dictionary building on PySpark."""
