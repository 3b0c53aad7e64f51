"""tessera: coded-terminology analytics as PySpark DataFrame plans."""
