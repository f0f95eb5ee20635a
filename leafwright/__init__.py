"""leafwright: quality analytics over recognised page texts, expressed as Spark plans."""
