"""Spatial, scene and corpus analytics as composable Spark DataFrame operators."""
