"""factspan: extraction, provenance and evaluation of scientific facts as Spark DataFrame jobs."""
