"""Training-data operators: text, token and vector jobs over a document corpus.

Every module here is one operator (plus ``common``, ``words`` and ``tokens``,
which they share). Nothing outside this subpackage imports it.
"""
