"""Named queries over the tables, and the SQL they are held against."""
