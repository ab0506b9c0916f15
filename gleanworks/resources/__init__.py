"""Files that ship with the package."""
