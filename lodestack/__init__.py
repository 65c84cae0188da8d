"""lodestack: document and tariff analytics expressed as Spark DataFrame plans."""
