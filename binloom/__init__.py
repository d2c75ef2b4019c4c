"""Analytics for assembled contigs, re-expressed as Spark DataFrame plans."""
