"""Column functions and driver-side helpers for bases, motifs and gaps."""
