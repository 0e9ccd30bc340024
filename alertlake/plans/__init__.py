"""Named queries over the shared test tables, each with its independent SQL statement."""
