"""Queries over the given tables: importing the package registers all of them."""

from sitewise.plans import evaluation, geocoding, matching, polygons, preparation, text  # noqa: F401
