"""edgeloom: labelled interaction networks on Spark."""
