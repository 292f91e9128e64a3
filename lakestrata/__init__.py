"""Versioned content stores on Spark: a key/value log and layered file packs."""
