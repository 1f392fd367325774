"""The six geocoders by name: batch in, batch out."""

from __future__ import annotations

from sitewise.functions.gridref import geocode_grid_ref
from sitewise.operators.geocode import lookup_postcodes
from sitewise.operators.polygon import check_in_area
from sitewise.operators.roads import junctions, lookup_roads
from sitewise.operators.search import search

GEOCODERS = {
    "postcode": lookup_postcodes, "grid_ref": geocode_grid_ref, "place": search, "road": lookup_roads,
    "intersect": junctions, "la_check": check_in_area,
}
