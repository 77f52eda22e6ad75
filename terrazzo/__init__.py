"""terrazzo: spatial and spatio-temporal point queries, index tables and updates as Spark plans."""
