"""From statements in the embedded-database dialect to Spark plans."""
