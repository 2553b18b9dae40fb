"""Page-session behaviour as streams."""
