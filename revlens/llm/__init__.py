"""Training-data operators: sharding, deduplication, scans, tokenising and
filtering of a document corpus, each as a Spark job over whole tables."""
