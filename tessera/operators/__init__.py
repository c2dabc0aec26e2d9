"""What is done with whole tables beyond queries: writing them to files."""
