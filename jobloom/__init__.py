"""Job-market analytics and corpus preparation as Spark DataFrame transforms."""
