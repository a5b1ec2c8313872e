"""caseloc: links issue reports to the source code they are about, as Spark jobs."""
