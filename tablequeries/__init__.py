"""The package's operators as queries over the given tables, each with SQL that must agree."""
