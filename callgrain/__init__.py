"""callgrain: a PySpark library for curating, auditing and describing corpora of call transcripts."""

__version__ = "0.1.0"
