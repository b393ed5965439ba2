"""Column-level building blocks: ids, text, URLs, vectors."""
