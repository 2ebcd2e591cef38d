"""quillspark: document retrieval, chunking and evaluation as PySpark DataFrame transformations."""

__version__ = "0.1.0"
