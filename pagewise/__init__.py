"""pagewise: document and OCR corpora as typed Spark DataFrames."""

__version__ = "0.1.0"
