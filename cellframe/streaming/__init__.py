"""Row-by-row consumption of built datasets, and stateless operators on streams."""
