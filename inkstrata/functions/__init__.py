"""Column functions: text in, columns out. Everything here is built-in Spark expressions."""
