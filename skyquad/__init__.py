"""A Spark engine for astrometric pattern matching: star catalogs, quad indexes, plate solutions."""
