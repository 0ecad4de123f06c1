"""Collection analytics on Spark: roles, layouts, tile pyramids, search and catalog queries."""
