"""Spark-native analytics for catalogues of labelled entities and the graphs between them."""
