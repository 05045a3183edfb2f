"""Column functions, and the few Python functions that Spark has no counterpart for."""
