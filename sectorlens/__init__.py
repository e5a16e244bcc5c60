"""Bottom-up industry classification as Spark DataFrame jobs: tables in, tables out."""
