"""chronoweave: Spark-native analytics over longitudinal event records and the graphs derived from them."""
