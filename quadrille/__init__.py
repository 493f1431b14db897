"""Quadrille: city-scale data preparation and entity resolution as Spark jobs."""
