"""Query catalogues: each module offers ``QUERIES`` and ``ORACLE_SQL``."""
