"""Where rows come from: event logs, file listings and generated tables."""
