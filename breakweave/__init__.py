"""breakweave: long-read structural-variant evidence analytics, written as Spark plans."""
