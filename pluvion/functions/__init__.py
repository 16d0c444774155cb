"""Part of pluvion."""
