"""Training-data operators: tokenising, scoring, de-duplicating, filtering and packing text.

Nothing else in the library imports this subpackage.
"""
