"""Where rows come from: fixture tables, and objects derived from the driver's tables."""
