"""The driver's queries over match data: `queries()` and the SQL they are checked against, `oracle_sql()`."""
