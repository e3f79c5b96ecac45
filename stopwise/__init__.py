"""Transit-delay analytics as ordinary Spark DataFrame functions."""
