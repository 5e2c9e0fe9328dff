"""Where rows come from and where they go: nested export requests, topics, tables."""
