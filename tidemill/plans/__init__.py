"""Named queries over the tables, each with the SQL that must give the same rows where SQL can say it."""
