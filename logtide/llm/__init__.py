"""Operators for preparing training text at scale.

Each module holds one operator with a general interface; ``queries`` and
``sql`` apply them to the tables of a data folder.
"""
