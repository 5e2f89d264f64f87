"""Panel preparation, reports, quality rules, commentary and profiles."""
