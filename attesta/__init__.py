"""attesta: a Spark engine over a bi-temporal, trust-weighted graph of claims."""

__version__ = "0.1.0"
