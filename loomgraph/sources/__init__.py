"""Graph sources and sinks: catalogs, S-expression and delimited readers, schemas, exports."""
