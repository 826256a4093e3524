"""Reading catalogue files, and reading and writing the tables of a lake."""
