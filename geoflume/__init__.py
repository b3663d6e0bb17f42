"""geoflume: environmental coverage queries as PySpark DataFrame jobs."""
