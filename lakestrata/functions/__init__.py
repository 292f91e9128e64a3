"""Scalar functions: checksums, codecs, binary deltas, paths."""
