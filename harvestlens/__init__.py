"""Crop-weather analytics as Spark DataFrame operators."""
