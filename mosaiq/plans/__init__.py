"""Named queries and their plain-SQL twins."""
