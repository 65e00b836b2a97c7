"""corpusq: build and query a text corpus on one subject as Spark jobs."""
