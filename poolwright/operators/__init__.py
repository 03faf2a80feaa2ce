"""Operators on pools, models, clusters, images, predictions and runs."""
