"""Queries over the driver's tables, by family, each with the SQL it is compared with where SQL can say it."""
