"""Part of pitspark."""
