"""Training-data operators: tokenising, filtering, de-duplicating and archiving documents.

Each module holds one operator with a general interface (any id and text
columns); ``queries`` registers the digest form of each over the fixture tables.
Nothing outside this subpackage imports it.
"""
