"""Building-energy analytics as Spark table operators."""
