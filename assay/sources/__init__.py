"""Reading and writing tables, artifacts and the evaluation store."""
