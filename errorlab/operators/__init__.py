"""DataFrame -> DataFrame operators, one module per family of SURVEY §2."""
