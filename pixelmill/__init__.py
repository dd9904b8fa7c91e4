"""Set-based dataset building and evaluation for pixel, point and manifest tables."""
