"""Part of lorewell; see the README for the map of modules."""
