"""Specification-curve analytics on Spark: every regression a set of choices allows, from a few scans."""
