"""Named queries over the tables, each with SQL for an independent engine where SQL can express it."""
