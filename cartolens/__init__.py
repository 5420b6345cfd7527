"""cartolens: a Spark-native inventory of the mapping applications that crawled web pages embed or link to."""
