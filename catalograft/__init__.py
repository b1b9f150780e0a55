"""Product catalogues from captured web pages, as Spark jobs."""
