"""toolguard: security analytics over tool servers, as set-oriented Spark jobs."""
