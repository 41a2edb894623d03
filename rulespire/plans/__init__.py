"""Fits and other multi-job work: level loop, forest, boosting, model choice, grids."""
