"""Part of amberlog; see the README for the map of modules."""
