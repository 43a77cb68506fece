"""Part of graphweft."""
