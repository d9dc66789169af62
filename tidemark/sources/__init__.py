"""Where rows come from and go to: collections, seeds, change logs, artifacts."""
