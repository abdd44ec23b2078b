"""Operators for training-data preparation over a corpus of documents, pages and chats.

Nothing outside this subpackage imports it; ``postmill.llm.registry`` holds its queries.
"""
