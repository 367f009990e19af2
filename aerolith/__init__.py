"""Urban micro-climate analytics expressed as Spark plans."""
