"""Operators of a training-data pipeline over large text corpora.

Nothing outside this subpackage imports it. Each module holds one operator;
``registry`` holds the queries and SQL that ``__spark_entry__`` registers.
"""
