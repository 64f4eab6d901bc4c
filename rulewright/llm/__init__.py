"""Training-data operators: ten Spark jobs over documents, pages and conversations.

Nothing outside this subpackage imports it.
"""
