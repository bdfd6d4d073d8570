"""Where rows come from and go to: template journal, projections, tables, definitions, shared storage."""
