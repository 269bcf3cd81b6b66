"""DataFrame-to-DataFrame operators; none of them collects data rows."""
