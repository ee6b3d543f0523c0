"""Contact-centre analytics expressed as Spark DataFrame jobs."""
