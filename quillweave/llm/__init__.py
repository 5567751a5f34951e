"""Corpus preparation operators for training data; nothing else in quillweave imports this subpackage."""
