"""Reading tables, SELECT texts, pages and partitioned database tables."""
