"""Part of siftline."""
