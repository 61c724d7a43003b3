"""Signal alignment over many recordings, as Spark jobs."""
