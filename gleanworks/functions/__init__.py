"""Part of gleanworks; see the package README section."""
