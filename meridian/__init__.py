"""A Spark engine for looking up the timezone of coordinates, whole tables at a time."""
