"""Column expressions: calendar fields, classes and the lunar phase."""
