"""Query plans over the functions and tables, with their twins in SQL."""
