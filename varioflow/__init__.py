"""varioflow: flight-log analysis and corpus jobs as Spark DataFrame pipelines."""
