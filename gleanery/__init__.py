"""gleanery: dataset curation and prediction analysis as PySpark DataFrame operators."""
