"""geoloom: spatial and training-data analytics as PySpark DataFrame functions."""
