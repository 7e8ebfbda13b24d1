"""Signal, population and similarity analytics over Spark tables and streams."""
