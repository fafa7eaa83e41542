"""pagemill: DataFrame operators for large tables of already fetched web pages."""

__version__ = "0.1.0"
