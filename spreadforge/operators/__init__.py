"""DataFrame -> DataFrame operators, grouped by stage."""
