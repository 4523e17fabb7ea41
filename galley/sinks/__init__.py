"""Jobs that write and rewrite stored tables."""
